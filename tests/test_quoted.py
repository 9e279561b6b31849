"""The CSV reader in blocks against the csv module over whole files."""

import csv
import random

import pytest

from quern.sources import quoted, readers


def cell(draw):
    return "".join(draw.choice(["a", ",", '"', "\n", "é", " ", '""', "xyz"]) for _ in range(draw.choice([0, 1, 3, 10, 30])))


@pytest.mark.parametrize("block", [150, 1000, 1 << 20])
def test_records_over_borders(spark, tmp_path, block):
    draw, want = random.Random(block), []
    for f in range(2):
        with open(tmp_path / f"{f}.csv", "w", newline="") as o:
            out = csv.writer(o, lineterminator="\n")
            out.writerow(["id", "te,xt", "n"])
            for i in range(200):
                row = [str(i), 'long\n"' * 200 if i == 100 else cell(draw), str(f)]  # one cell spans blocks
                out.writerow(row)
                want.append(tuple(x or None for x in row))
            o.write('7,5" pipe,9\n\n8,too,many,fields\n9\n')
            want += [("7", '5" pipe', "9"), ("9", None, None)]
    got = quoted.scan(spark, str(tmp_path), block=block)
    assert got.columns == ["id", "te,xt", "n"] and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert got.rdd.getNumPartitions() > (20 if block == 150 else 1)
    some = quoted.scan(spark, str(tmp_path), ["n"], block)
    assert some.columns == ["n"] and some.count() == len(want)


def test_line_ends():
    """States at the ends of lines against a reader, character by character."""

    def plain(line, inside):
        state = "in" if inside else "start"
        for c in line:
            if state == "start":
                state = "in" if c == '"' else "start" if c == "," else "plain"
            elif state == "plain":
                state = "start" if c == "," else "plain"
            elif state == "in":
                state = "quote" if c == '"' else "in"
            else:
                state = "in" if c == '"' else "start" if c == "," else "plain"
        return state == "in"

    draw = random.Random(1)
    for _ in range(20_000):
        line = "".join(draw.choice('a",') for _ in range(draw.randrange(9)))
        for inside in (False, True):
            assert quoted.ends_open(line, inside) == plain(line, inside), (line, inside)


def test_blocks_that_changed(spark, tmp_path):
    with pytest.raises(RuntimeError):
        import pyarrow as pa

        b = pa.record_batch({"file": [1], "block": [5], "value": ["a"]})
        list(quoted._cut(iter([b]), {(1, 0): False}))


def test_recipes_in_blocks(spark, tmp_path):
    (tmp_path / "r.csv").write_text('RecipeId,Name,Ingredients,Steps,x\n' + "".join(f'{i},"n ""{i}""\nline",NA,"a, b",\n' for i in range(100)))
    got = readers.recipes_csv(spark, str(tmp_path), 300)
    rows = sorted(got.collect(), key=lambda r: int(r.id))
    assert got.rdd.getNumPartitions() > 5 and [r.name for r in rows] == [f'n "{i}"\nline' for i in range(100)]
    assert all(r.parts is None and r.instructions == "a, b" and r.category is None for r in rows)
