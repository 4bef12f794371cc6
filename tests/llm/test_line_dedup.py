import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import line_dedup


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows: list[tuple], edits: int, least: int) -> dict:
    firsts: dict[str, tuple] = {}
    for i, text in sorted((r for r in rows if r[0] is not None and r[1] is not None)):
        for at, line in enumerate(text.split("\n")):
            if len(line) >= least:
                firsts.setdefault(line, (i, at))
    near = {line for line, place in firsts.items() for other, before in firsts.items() if before < place and abs(len(line) - len(other)) <= edits and distance(line, other) <= edits}
    return {i: text if text is None or i is None else "\n".join(x for at, x in enumerate(text.split("\n")) if len(x) < least or firsts[x] == (i, at) and x not in near) for i, text in rows}


def changed(rng, line: str, times: int) -> str:
    for _ in range(times):
        at = rng.randrange(len(line) + 1)
        kind = rng.randrange(3)
        line = line[:at] + (rng.choice("abé") if kind < 2 else "") + line[at + (kind > 0) :]
    return line


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_near_lines_agree_with_brute_force(spark, edits):
    rng = random.Random(edits)
    bases = ["".join(rng.choice("abé") for _ in range(rng.choice((8, 11, 24, 40)))) for _ in range(12)]
    lines = [changed(rng, rng.choice(bases), rng.randrange(edits + 3)) for _ in range(160)]
    rows = [(i, "\n".join(lines[i * 8 : i * 8 + 8])) for i in range(20)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), edits, 8).collect()
    assert {r["doc_id"]: r["text"] for r in out} == brute(rows, edits, 8)


@pytest.mark.parametrize("edits", [1, 2])
def test_crowded_keys_agree_with_brute_force(spark, edits):
    """One base line with a few places changed: at the first two levels, nearly every key is crowded."""
    rng = random.Random(edits)
    base = [rng.choice("abcdefghéñ") + rng.choice("xyz") * 3 for _ in range(16)]
    lines = set()
    for _ in range(150):
        words = list(base)
        for _ in range(rng.randrange(3)):
            words[rng.randrange(16)] = "".join(rng.choice("pqrst") for _ in range(rng.choice((3, 4, 4, 5))))
        lines.add(changed(rng, " ".join(words), rng.randrange(2)))
    firsts = {line: (i, i) for i, line in enumerate(sorted(lines, key=lambda x: rng.random()))}
    df = spark.createDataFrame([(line, place) for line, place in firsts.items()], "line string, first struct<doc_id:long,at:int>").repartition(4)
    near = {p for line, p in firsts.items() for other, before in firsts.items() if before < p and distance(line, other) <= edits}
    assert {tuple(r["first"]) for r in line_dedup.near_lines(df, edits, crowd=0 if edits == 1 else 3, most_sent=edits % 2, rows=150 if edits == 1 else None).collect()} == near
    assert 0 < len(near) < len(firsts)


@pytest.mark.parametrize("edits", [1, 2, 3, 4])
def test_lengths_about_the_ends_of_classes_agree_with_brute_force(spark, edits):
    rng = random.Random(edits)
    firsts = {}
    for n in (15, 16, 30, 32, 34, 63, 64, 66, 128, 129, 256, 287, 288):
        base = "".join(rng.choice("abcdefghijé ") for _ in range(n))
        for line in {base, *(changed(rng, base, rng.randrange(1, edits + 2)) for _ in range(12))}:
            firsts[line] = rng.randrange(1 << 40)
    df = spark.createDataFrame([(line, (i, i)) for line, i in firsts.items()], "line string, first struct<doc_id:long,at:long>").repartition(4)
    near = {i for line, i in firsts.items() for other, before in firsts.items() if before < i and abs(len(line) - len(other)) <= edits and distance(line, other) <= edits}
    assert {r["first"]["at"] for r in line_dedup.near_lines(df, edits).collect()} == near
    assert 0 < len(near) < len(firsts)


def test_a_line_has_few_keys(spark, monkeypatch):
    """With two edits, three keys in the index and little more than four that it looks up, whatever the shorter line's length."""
    rng = random.Random(3)
    lines = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(n)) for n in range(64, 464)]
    seen, meetings = [], line_dedup._meetings

    def counted(index, lookup, *args, **named):
        seen.append((index.count(), lookup.count()))
        return meetings(index, lookup, *args, **named)

    monkeypatch.setattr(line_dedup, "_meetings", counted)
    df = spark.createDataFrame([(line, (i, i)) for i, line in enumerate(lines)], "line string, first struct<doc_id:long,at:int>")
    assert line_dedup.near_lines(df, 2).count() == 0
    assert seen[0][0] == 3 * len(lines) and seen[0][1] < 5 * len(lines)


def crowded_by(crowds: list, meetings=line_dedup._meetings):
    """_meetings with these bounds on crowds, one for each level."""
    left = list(crowds)
    return lambda index, lookup, crowd, *args: meetings(index, lookup, left.pop(0), *args)


@pytest.mark.parametrize("edits, crowds", [(1, (0, None)), (2, (0, None)), (2, (0, 0, None)), (3, (0, None)), (3, (0, 0, None)), (4, (0, None))])
def test_each_level_of_finer_keys_finds_all_pairs(spark, monkeypatch, edits, crowds):
    """All keys of the levels before are crowded, so that one level has to find every pair, across classes of lengths too."""
    rng = random.Random(edits)
    firsts = {}
    for n in (21, 30, 33, 64, 66, 129):
        base = "".join(rng.choice("abcé ") for _ in range(n))
        for line in {base, *(changed(rng, base, rng.randrange(1, edits + 2)) for _ in range(30))}:
            firsts[line] = rng.randrange(1 << 40)
    df = spark.createDataFrame([(line, (i, i)) for line, i in firsts.items()], "line string, first struct<doc_id:long,at:long>").repartition(4)
    near = {i for line, i in firsts.items() for other, before in firsts.items() if before < i and abs(len(line) - len(other)) <= edits and distance(line, other) <= edits}
    monkeypatch.setattr(line_dedup, "_meetings", crowded_by(crowds))
    assert {r["first"]["at"] for r in line_dedup.near_lines(df, edits).collect()} == near
    assert 0 < len(near) < len(firsts)


def test_the_rows_of_a_crowd_grow_with_its_lines(spark, monkeypatch):
    """One line with four characters put in somewhere: twice the copies make twice the keys, and few of their pairs agree in their signatures."""
    rng = random.Random(6)
    base = "".join(rng.choice("abcdefghijklmnop ") for _ in range(300))
    copies = list({base[:at] + "".join(rng.choice("qrstuvwxyz") for _ in range(4)) + base[at:] for at in (rng.randrange(300) for _ in range(400))})
    meetings = line_dedup._meetings

    def rows(n: int) -> list[tuple[int, int, int]]:
        seen = []

        def counted(index, lookup, *args, **named):
            pairs, dense = meetings(index, lookup, *args, **named)
            seen.append((index.count(), lookup.count(), pairs.count()))
            return pairs, dense

        monkeypatch.setattr(line_dedup, "_meetings", counted)
        df = spark.createDataFrame([(line, (i, i)) for i, line in enumerate(copies[:n])], "line string, first struct<doc_id:long,at:int>")
        line_dedup.near_lines(df, 2).count()
        return seen

    for n, seen in ((150, rows(150)), (300, rows(300))):
        assert [index for index, _, _ in seen] == [3 * n, 6 * n, 10 * n]
        assert seen[1][1] <= 24 * n and seen[2][1] <= 42 * n
        assert seen[1][2] + seen[2][2] <= n * n // 20


def test_rows_that_repeat_an_id_with_other_texts(spark):
    rows = [(1, "this is the one line that others repeat"), (2, "this is the one line that others repeat!"), (2, "a wholly different and unique line of text\nand one more that is its own"), (2, "a third text that has nothing to do with these")]
    rows += [(3, "the first of two equal rows of text"), (3, "the first of two equal rows of text")]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == sorted((i, "" if t.endswith("!") else t) for i, t in rows)


def test_distance(spark):
    rng = random.Random(5)
    pairs = []
    for _ in range(300):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 14)))
        pairs.append((a, changed(rng, a, rng.randrange(5))))
    pairs = [p for p in pairs if p[0] and p[1]]
    for edits in (1, 2, 4):
        got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", line_dedup.within_edits(F.col("a"), F.col("b"), edits).alias("x")).collect()
        for r in got:
            assert r["x"] == (distance(r["a"], r["b"]) <= edits), (r, edits)


def test_statistics_odd_rows_and_columns(spark, odd_documents):
    out = line_dedup.dedup_lines(odd_documents)
    assert out.columns == [*odd_documents.columns, "line_stats"] and out.count() == odd_documents.count()
    rows = {(r["doc_id"], r["text"]): r["line_stats"] for r in out.collect() if r["doc_id"] != 5}
    assert rows[(2, None)]["n_lines"] == 0 and rows[(3, "")]["n_lines"] == 1 and rows[(6, "")]["n_equal"] == 2
    assert (None, None) in rows and (7, "één déjà-vu; ça va? 你好 世界") in rows
    assert line_dedup.dedup_lines(odd_documents.limit(0)).count() == 0
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(odd_documents, edits=0)


def test_short_lines_that_repeat(spark):
    rows = [(1, "Home\n\nMenu\n \nHome\nab"), (2, "Menu\nHomes\n\nac\né"), (3, "é\n" + " " * 25 + "\nx"), (4, " " * 25 + "\nLes.")]
    rows += [(i, f"Les.\nown line {i}") for i in range(5, 40)]
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = {i: r["text"] for i, r in out.items()}
    assert texts[1] == "Home\n\nMenu\n \nab" and texts[2] == "Homes\n\nac\né" and texts[3] == " " * 25 + "\nx" and texts[4] == "Les."
    assert all(texts[i] == f"own line {i}" and out[i]["line_stats"]["n_equal"] == 1 for i in range(5, 40))


@pytest.mark.parametrize("edits", [1, 2])
def test_short_lines_within_edits_agree_with_brute_force(spark, edits):
    """near_chars=1: segments may be empty, so that nearly all short lines meet."""
    rng = random.Random(edits)
    lines = ["".join(rng.choice("abcdefghijklé ") for _ in range(rng.randrange(9))) for _ in range(120)]
    rows = [(i, "\n".join(lines[i * 6 : i * 6 + 6])) for i in range(20)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), edits, near_chars=1).collect()
    assert {r["doc_id"]: r["text"] for r in out} == brute(rows, edits, 1)
