"""Prompts and chat rows, as column expressions. Wording is data: pass your own."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import coin
from .text import let, strip

# The system turn, and how many tokens a reply may have, by richness tier.
SYSTEM = (
    "You are a culinary adaptation assistant. Priority: (1) strict dietary compliance, (2) preserve dish identity and flavor profile, (3) keep instructions practical and cookable. "
    "Never include forbidden ingredients or their derivatives (stocks, sauces, pastes, broths). If no exact compliant substitute exists, acknowledge the gap, choose the closest viable option, and state the trade-off. "
    "Output sections exactly: Substitution Plan, Adapted Ingredients, Adapted Steps, Flavor Preservation Notes, Constraint Check."
)
SYSTEMS = {
    "concise": SYSTEM + " Be concise: keep rationale to one phrase per substitution and provide exactly 3 flavor preservation notes.",
    "standard": SYSTEM,
    "rich": SYSTEM + " For each substitution provide deep rationale covering flavor chemistry, texture mechanics, and technique adjustments. Include one alternative swap option per substitution. Provide at least 5 concrete flavor preservation notes.",
}
BUDGET = {"concise": 512, "standard": 1024, "rich": 2048}


def prose(steps: Column) -> Column:
    """Steps as sentences."""
    done = F.transform(steps, lambda s: F.when((strip(s) != "") & ~F.endswith(strip(s), F.lit(".")), F.concat(strip(s), F.lit("."))).otherwise(strip(s)))
    return F.array_join(done, " ")


def _listed(items: Column, mark: str) -> Column:
    """``1) a 2) b`` or ``1. a`` lines."""
    one = lambda s, i: F.concat((i + 1).cast("string"), F.lit(mark), strip(s))
    return F.transform(items, one)


# The wording of the user turn in each template; {extra} stands for EXTRA where the coin says so.
WORDING = {
    "A": "Recipe: {title}\nCuisine: {cuisine}\nIngredients: {comma}\nSteps: {inline}\nRestrictions: {restriction}\nMust Keep Flavor Notes: {notes}",
    "B": "I have a recipe for {title} ({cuisine}) that I need to make {restriction}-friendly.\n\nThe ingredients are: {comma}.\n\nHere's how it's made: {prose}\n\nPlease adapt it while keeping the dish recognizable.",
    "C": "Goal: make {title} fully {restriction}-compliant.\n\nSource ingredients:\n{bullets}\n\nSource steps:\n{numbered}\n\nPreserve these flavors: {notes}.{extra}",
}
EXTRA = "\nWeeknight-friendly, under 45 minutes where possible."


def filled(wording: str, fields: dict[str, Column]) -> Column:
    """``wording`` with each {name} in it replaced by the column of that name."""
    parts = re.split(r"\{(\w+)\}", wording)
    return F.concat(*[fields[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def user_prompt(template: Column, title: Column, items: Column, steps: Column, constraint: Column, cuisine: Column, notes: Column, wording: dict[str, str] = WORDING, extra: str = EXTRA) -> Column:
    """The user turn in one of three templates (any other than A and B is C). The optional line hangs on the constraint
    alone."""
    fields = {
        "title": title, "cuisine": cuisine, "restriction": F.replace(constraint, F.lit("_"), F.lit("-")), "notes": F.array_join(notes, ", "), "comma": F.array_join(items, ", "), "prose": prose(steps),
        "inline": F.array_join(F.transform(_listed(steps, ") "), lambda s: F.rtrim(s, F.lit("."))), " "),
        "bullets": F.array_join(F.transform(items, lambda i: F.concat(F.lit("- "), i)), "\n"), "numbered": F.array_join(_listed(steps, ". "), "\n"),
        "extra": F.when(coin(F.lit(""), constraint), extra).otherwise(""),
    }
    a, b, c = (filled(wording[t], fields) for t in "ABC")
    return let(template, lambda t: F.when(t == "A", a).when(t == "B", b).otherwise(c))


# What a judge is told, and asked for.
JUDGE_SYSTEM = "You are an expert evaluator for recipe adaptation outputs. Score strictly and return JSON only."
JUDGE_USER = (
    "Evaluate the model output.\n\nRestrictions: {restrictions}\n\nOriginal user request:\n{user}\n\nModel output:\n{output}\n\n"
    "Return JSON with keys: compliance (1-10), flavor_fidelity (1-10), dish_identity_preservation (1-10), explanation_quality (1-10), overall_score (float 1-10), verdict (PASS/FAIL), notes (string)."
)


def judge_messages(restrictions: Column, user: Column, output: Column) -> Column:
    """The two messages that ask a judge for its scores."""
    named = F.when(F.size(restrictions) > 0, F.array_join(restrictions, ", ")).otherwise("(not provided)")
    return chat(F.lit(JUDGE_SYSTEM), filled(JUDGE_USER, {"restrictions": named, "user": user, "output": output}))


def by_tier(tier: Column, values: dict) -> Column:
    """A value for each richness tier."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in sorted(values.items()) for x in pair]), tier)


def chat(system: Column, user: Column) -> Column:
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(turn("system", system), turn("user", user))


def assistant_text(parsed: Column) -> Column:
    """A response put together again from its sections; empty ones are left out."""
    from .sections import HEADERS

    bodies = [parsed[k] for k in ("plan", "ingredients_text", "steps_text", "notes", "check")]
    parts = F.array(*[F.when(b != "", F.concat(F.lit(h + ":\n"), b)) for h, b in zip(HEADERS, bodies, strict=True)])
    return F.array_join(F.filter(parts, lambda p: p.isNotNull()), "\n\n")


def export_messages(prompt: Column, parsed: Column) -> Column:
    return F.array_append(prompt, F.struct(F.lit("assistant").alias("role"), assistant_text(parsed).alias("content")))


def endpoint_message(user: Column, names: Column) -> Column:
    """The user text behind its restrictions, where there are any (the words before them are a fixed value)."""
    shown = F.array_join(F.transform(names, lambda n: F.replace(n, F.lit("_"), F.lit(" "))), ", ")
    return F.when(F.size(names) > 0, F.concat(F.lit("Adapt this recipe for: "), shown, F.lit("\n\n"), user)).otherwise(user)


def demo_prompt(user: Column, names: Column) -> Column:
    """The user text with its restrictions that are not blank behind it."""
    kept = F.filter(F.transform(names, lambda n: strip(n)), lambda n: n != "")
    return F.when(F.size(kept) > 0, F.concat(strip(user), F.lit("\n\nRestrictions: "), F.array_join(kept, ", "))).otherwise(strip(user))
