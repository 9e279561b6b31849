"""Personal data by weak supervision.

Patterns propose spans: the base patterns (which always count) and looser ones (written-out e-mail addresses, phone
numbers without a plus sign, keys and passwords, base matches that fail their check). Four labelers vote yes, no or not at all on each: the
pattern itself, a gazetteer (domain endings, address ranges, calling codes, issuer prefixes, forms of keys), the words around, and how the
span stands in its surroundings. How often each combination of votes and of a span's shape occurs is counted over all documents in Spark;
expectation-maximisation on those counts estimates each labeler's reliability by kind, without any labels; and a
logistic span classifier on votes, kind and shape (how long a span is, how much of it digits) is trained on the combinations, weighted by the
posteriors. A looser span is added where the
classifier gives it one half at least and no other span overlaps it; a base match that fails its check is never added, and
takes no room from others.

Counts n_* are of base spans; ``spans`` holds base and added ones, n_added counts the added, and ``personal`` says whether there
is any. Offsets are in code points, ends exclusive.

Defined cases: null and empty texts have no spans; repeated rows are judged each by itself; other columns play no
part; with no candidates at all nothing is added.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum
from .common import drop, keep, lean, numbered, only, workers

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
AROUND = 40

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_DIGIT = re.compile("[0-9]")
_ALPHA = re.compile("[A-Za-z]")
# A match of either ends with a whole run of digits, so none can start inside one: the look-behinds change no result
# and keep long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SPELT = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]++)\s?(?:\(at\)|\[at\]|\{at\}|\sat\s)\s?([A-Za-z0-9-]++)((?:\s?(?:\(dot\)|\[dot\]|\{dot\}|\sdot\s|\.)\s?[A-Za-z0-9-]++)++)", re.I)
#: What no written-out address is without.
_SPELT_HINT = re.compile(r"[(\[{]at[)\]}]|\sat\s", re.I)
#: Long runs of key characters, and what stands behind the name of a key or password.
_RUN = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{20,}={0,2}")
_NAMED = re.compile(r"(?<![A-Za-z])(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?([^\s\"',;]{6,}+)", re.I)
_LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+.])(?:\([0-9]{2,4}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])")

# What the gazetteer and the context labeler know. Domains end in two letters (countries) or in one of
# ENDINGS; CALLING holds the calling codes of one and two digits, and the first two of those of three.
ENDINGS = {"com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "aero", "coop", "museum", "jobs", "mobi", "travel", "tel", "cat", "asia", "app", "dev", "cloud", "online", "shop", "site", "store", "tech", "xyz", "club", "email"}
CALLING = {"1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98",
           "21", "22", "23", "24", "25", "26", "29", "35", "37", "38", "42", "50", "59", "67", "68", "69", "80", "85", "87", "88", "96", "97", "99"}
ISSUERS = re.compile(r"4\d{12,18}$|5[1-5]\d{14}$|2[2-7]\d{14}$|3[47]\d{13}$|3[0689]\d{12}|6(?:011|5|4[4-9])\d|35\d{14}$|62\d{14}")
RESERVED = re.compile(r"(?:0|10|127|2[2-5]\d)\.|169\.254\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.")
KEY_FORMS = re.compile(r"(?:AKIA|ASIA|ghp_|gho_|xox[bap]-|sk[-_]|pk_|eyJ|AIza)|(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})$")
CUES = {
    "email": re.compile(r"mail|contact|write|courriel|correo|kontakt", re.I),
    "ip": re.compile(r"\bip\b|server|host|addr|login|client", re.I),
    "card": re.compile(r"card|visa|credit|karte|carte|tarjeta|payment", re.I),
    "phone": re.compile(r"phone|\btel|call|mobile|fax|telefon|m[oó]vil", re.I),
    "secret": re.compile(r"token|secret|passw|pwd|key|auth|credential|bearer", re.I),
}
AGAINST = re.compile(r"version|\bver\b|isbn|issn|order|invoice|\bno\.|\bsection|serial|https?:|commit|digest|checksum", re.I)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of the base pattern: a run of local characters, @, a domain with a dot."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL_END.match(text, start - 1):
            start -= 1
        done_here = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = done_here = m.end()
        else:
            done = at + 1  # no match can reach over this sign
        at = text.find("@", done_here)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _keys(text: str, start: int, end: int) -> Iterator[tuple[str, int, int, int]]:
    """Long runs of letters and digits that begin within a stretch between named ones."""
    for m in _RUN.finditer(text, start, end):  # none reaches from before a named one into it
        if _DIGIT.search(m[0]) and _ALPHA.search(m[0]):
            yield "secret", m.start(), m.end(), 1


def proposals(text: str) -> Iterator[tuple[str, int, int, int]]:
    """(kind, start, end, source): source 2 for base spans, 1 for looser patterns, 0 for base matches that fail."""
    for a, b in _emails(text) if "@" in text else ():
        yield "email", a, b, 2
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            yield "ip", m.start(), m.end(), 2 * all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19:
                yield "card", m.start(), m.end(), 2 * luhn(digits)
        for m in _PHONE.finditer(text) if "+" in text else ():
            n = sum(map(str.isdigit, m[0]))
            yield "phone", m.start(), m.end(), 2 * (10 <= n <= 15)
        for m in _LOCAL_PHONE.finditer(text):
            yield "phone", m.start(), m.end(), 1
    if _SPELT_HINT.search(text):
        for m in _SPELT.finditer(text):
            yield "email", m.start(), m.end(), 1
    end = 0
    for m in _NAMED.finditer(text) if "=" in text or ":" in text else ():
        yield from _keys(text, end, m.start(1))
        yield "secret", m.start(1), m.end(1), 1
        end = m.end(1)
    yield from _keys(text, end, len(text))


def _gazetteer(kind: str, span: str) -> int:
    digits = re.sub("[^0-9]", "", span)
    if kind == "email":
        ending = re.split(r"[^A-Za-z0-9-]+", span)[-1].lower()
        good = ending in ENDINGS or len(ending) == 2 and ending.isalpha()
    elif kind == "ip":
        good = not RESERVED.match(span.lstrip("0") or "0.")
    elif kind == "card":
        good = ISSUERS.match(digits)
    elif kind == "phone":
        good = digits[:1] in CALLING or digits[:2] in CALLING if span[0] == "+" else digits[:1] in set("23456789")
    else:
        good = KEY_FORMS.match(span)
    return 1 if good else -1


def votes(text: str, kind: str, start: int, end: int, source: int) -> tuple[int, int, int, int]:
    """Yes (1), no (-1) or no vote (0) of pattern, gazetteer, context and surroundings."""
    before = text[max(0, start - AROUND) : start]
    context = 1 if CUES[kind].search(before) else -1 if AGAINST.search(before) else 0
    glued = (start > 0 and text[start - 1].isalnum()) + (end < len(text) and text[end].isalnum())
    if kind == "secret" and not glued:
        glued = not re.search(r"[:=]\s{0,3}[\"']?$", before)  # a key is assigned to something
    return (source - 1, _gazetteer(kind, text[start:end]), context, 1 if not glued else -1)


SHAPES = 4


def shape(span: str) -> int:
    """Two bits: whether a span is long, and whether most of it is digits."""
    return 2 * (len(span) > 18) + (2 * sum("0" <= c <= "9" for c in span) > len(span))


def code(kind: str, vote: tuple[int, ...], shape_: int = 0) -> int:
    """One small number for a kind, its votes and the span's shape."""
    out = KINDS.index(kind)
    for v in vote:
        out = out * 3 + v + 1
    return out * SHAPES + shape_


def decode(number: int) -> tuple[str, tuple[int, ...], int]:
    number, shape_ = divmod(number, SHAPES)
    vote = []
    for _ in range(4):
        vote.append(number % 3 - 1)
        number //= 3
    return KINDS[number], tuple(reversed(vote)), shape_


def spans(text: str | None) -> list[tuple[int, int, int, int, bool]]:
    """(start, kind's place, end, code, base) in order; looser spans that overlap another are left out. What fails its check
    can't be added, and so keeps nothing out."""
    if not text:
        return []
    found = sorted((a, KINDS.index(k), b, code(k, votes(text, k, a, b, s), shape(text[a:b])), s) for k, a, b, s in proposals(text))
    taken = sorted((a, b) for a, _, b, _, s in found if s == 2)
    starts, reach = [a for a, _ in taken], np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []
    out, end = [], 0
    for a, k, b, c, s in found:
        if s < 2:
            i = bisect_left(starts, b)
            if i and reach[i - 1] > a or s and a < end:
                continue
            end = b if s else end
        out.append((a, k, b, c, s == 2))
    return out


def reliabilities(counts: dict[int, int], rounds: int = 50) -> tuple[dict[int, float], dict[str, np.ndarray]]:
    """Expectation-maximisation over counts of vote combinations, by kind.

    Returns each combination's posterior of being personal data, and for each kind (2, 4, 3): how likely each labeler
    says no, nothing or yes where it is not and where it is.
    """
    posterior, tables = {}, {}
    for kind in KINDS:
        mine = [(n, decode(n)[1], c) for n, c in sorted(counts.items()) if decode(n)[0] == kind]
        if not mine:
            continue
        vote = np.array([v for _, v, _ in mine]) + 1
        weight = np.array([c for _, _, c in mine], float)
        p = 1 / (1 + np.exp(-1.5 * (vote - 1).sum(1)))  # first a majority vote
        for _ in range(rounds):
            table = np.full((2, 4, 3), 1.0)
            table[0, :, 0] += 2  # a labeler is right more often than not
            table[1, :, 2] += 2
            for j in range(4):
                np.add.at(table[1, j], vote[:, j], weight * p)
                np.add.at(table[0, j], vote[:, j], weight * (1 - p))
            table /= table.sum(2, keepdims=True)
            prior = (weight @ p + 1) / (weight.sum() + 2)
            odds = np.log(prior / (1 - prior)) + sum(np.log(table[1, j][vote[:, j]] / table[0, j][vote[:, j]]) for j in range(4))
            p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        tables[kind] = table
        posterior |= {n: float(x) for (n, _, _), x in zip(mine, p, strict=True)}
    return posterior, tables


def _row(number: int) -> np.ndarray:
    kind, vote, shape_ = decode(number)
    out = np.zeros(len(KINDS) * (1 + SHAPES) + 8)
    out[KINDS.index(kind)] = 1
    out[len(KINDS) + KINDS.index(kind) * SHAPES + shape_] = 1
    for j, v in enumerate(vote):
        out[len(KINDS) * (1 + SHAPES) + 2 * j + (v > 0)] = abs(v)
    return out


def classifier(counts: dict[int, int], posterior: dict[int, float], rounds: int = 30, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression on votes, kind and shape, each combination twice with its posterior's weights (Newton)."""
    x = np.array([_row(n) for n in sorted(counts)])
    weight = np.array([counts[n] for n in sorted(counts)], float)
    target = np.array([posterior[n] for n in sorted(counts)])
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (target - p)) - ridge * beta
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        beta += np.linalg.solve(hess, grad)
    return beta


def accepted(counts: dict[int, int]) -> list[int]:
    """The vote combinations of looser spans that the trained classifier takes. Base matches that fail their check
    take part in the fit, as what personal data does not look like, but are never added."""
    if not counts:
        return []
    beta = classifier(counts, reliabilities(counts)[0])
    return [n for n in range(len(KINDS) * 3**4 * SHAPES) if decode(n)[1][0] == 0 and _row(n) @ beta >= 0]


_FOUND = "doc_id long, found array<struct<start:int,kind:string,end:int,code:int,base:boolean>>"


def propose(docs: DataFrame) -> DataFrame:
    """_FOUND for each row of ``docs`` (doc_id, text)."""
    workers(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32()), ("code", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in textnum.slices(whole, "text"):
                rows = [[{"start": a, "kind": KINDS[k], "end": e, "code": c, "base": base} for a, k, e, c, base in spans(t)] for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "found"])

    return docs.mapInArrow(lean(run), _FOUND)


def _counts(found: DataFrame) -> dict[int, int]:
    """How often each combination of kind, votes and shape occurs: at most 1,620 rows."""
    return {r["code"]: r["count"] for r in found.select(F.explode("found.code").alias("code")).groupBy("code").count().collect()}


def _number(found, kind: str):
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, personal for each row of ``docs`` (doc_id, text)."""
    found = keep(propose(only(docs, doc_id="long", text="string")))
    good = F.array(*[F.lit(n) for n in accepted(_counts(found))]).cast("array<int>")
    line = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base, added = F.filter("found", lambda s: s["base"]), F.filter("found", lambda s: ~s["base"] & F.array_contains(good, s["code"]))
    return found.select(
        "doc_id",
        *[_number(base, k).alias(f"n_{k}") for k in BASE],
        F.sha2(line(base).cast("binary"), 256).alias("base_sha256"),
        line(F.filter("found", lambda s: s["base"] | F.array_contains(good, s["code"]))).alias("spans"),
        F.size(added).cast("long").alias("n_added"),
        (F.size(base) + F.size(added) > 0).alias("personal"),
    )


def mask(text: str | None, good: set[int]) -> str | None:
    """The text with each run of overlapping spans replaced by the first one's kind in brackets."""
    out, at, end = [], 0, 0
    for a, kind, b, c, base in spans(text):
        if not (base or c in good):
            continue
        if a >= end:
            out += [text[at:a] if a > at else "", f"[{KINDS[kind].upper()}]"]
        end = at = max(end, b)
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and others), one row for one, with personal data in ``text`` masked."""
    from pyspark.sql.pandas.types import to_arrow_schema

    found = keep(propose(only(docs, doc_id="long", text="string")))
    good = set(accepted(_counts(found)))
    drop(found)
    plain = numbered(docs, "text")
    schema = to_arrow_schema(plain.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in textnum.slices(whole, "text"):
                texts = pa.array([mask(t, good) for t in b.column("text").to_pylist()], schema.field("text").type)
                yield pa.RecordBatch.from_arrays([texts if f.name == "text" else b.column(f.name).cast(f.type) for f in schema], schema=schema)

    return plain.mapInArrow(lean(run), plain.schema).toDF(*docs.columns)
