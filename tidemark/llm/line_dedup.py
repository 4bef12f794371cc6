"""Line dedup: a segment-partition edit join over the different lines of a corpus.

Of equal lines the first stays, by (doc_id, number of the line), however short they are; only
blank lines under near_chars code points, which divide paragraphs, stay as they are. A line of
at least near_chars whose first place comes after that of another such line within `edits`
insertions, deletions and substitutions goes as well. In shorter lines so few edits make
another word or number, so these are only compared for equality.

To find those pairs, each line has edits + 1 segments, which are as long as if the line had
the least length of its class; lines of about the same length are one class, an eighth of
their length wide at most. Segments of the first half count their places from the line's
start, the others from its end. If two lines are within reach, the longer one holds some
segment of the shorter one unchanged, and it begins where the segment does, give or take as
many places as edits can lie before it, or after it. Each line therefore has edits + 1 index
keys (its segments, by class and number) and looks up the substrings at those places for its
own class and, where it is up to `edits` longer than the lines of a lower one, for that. So
the first segment is one key whatever the other line's length, and so is the last. Pairs that
share a key and are near in length are verified by an edit distance whose states are bits:
for each number of errors so far a band of 2 * edits + 1 places of the other line, all moved
by one step per character.

Lines that differ in a few words share long segments, and all pairs of a group of such lines
would be verified. A key that more than `crowd` lines have in the index is therefore not
joined; the lines that meet there are compared by finer keys instead: cut into edits + 2
segments, two of which a pair within reach has unchanged, and where those are crowded too,
into edits + 3, of which three are. The number of finer keys of a line has a bound that
doesn't depend on the others: with two edits 6 and then 10 in the index, 24 and then 42 that
it looks up (the first less where it is inside a class). The last keys are joined whatever
their size, so that no pair is lost, and each length has its own. Pairs of finer keys also
have to agree in a signature: the parities of 256 classes of neighbouring characters, of which
one edit changes four at most, and of 64 classes of characters, of which it changes two; the
join drops pairs that differ in more. So the rows made grow with the lines, but for those that
differ from each other in one or two places only; there the join still looks at each pair's
signatures, and emits the few per cent that agree.

Only keys and line hashes are dealt out for the join. A line's text is fetched for pairs that
share a key, by sending the hashes to the lines as long as they are few (`most_sent`), and by
shuffling beyond that. A line with a third of all occurrences is one row after the first
grouping, which sums up in each task before it shuffles; decisions go back as places of first
occurrences, so that no join has a key for a frequent line. A place is a row, by its id and a
hash of its text, and the number of a line in it.

Defined results: a null text stays null and an empty one empty; documents without an id stay
as they are and are not compared; of rows that repeat an id and a text, all keep the same
lines; rows that repeat an id with other texts are compared like any other rows, in the order
of those hashes; no documents give no rows; other columns stay.
"""

from __future__ import annotations

from functools import cache, reduce
from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import let
from ..session import stash

NEAR_CHARS = 20
CROWD = 16
#: How many unchanged segments a key holds, level by level, and how many keys a line may have for it.
MATCHED, MOST_KEYS = (2, 3), 400
#: Index keys in a task up to which they go into a hash table.
HASHED = 1_000_000


def _wide(line: Column) -> Column:
    """Four bytes for each code point, so that a place in a line is a place in its bytes."""
    return F.encode(line, "UTF-32").alias("wide")


def _size() -> Column:
    return F.shiftright(F.octet_length("wide"), 2)


def _cut(start: Column, length: Column) -> Column:
    return F.substring("wide", 4 * start + 1, 4 * length)


def _bounds(size: Column, i: int | Column, parts: int) -> tuple[Column, Column]:
    """Where segment i of a line of this length starts, and its length."""
    start, end = F.floor(size * i / parts), F.floor(size * (i + 1) / parts)
    return start.cast("int"), (end - start).cast("int")


def _least(size: Column) -> Column:
    """The least length in the class of lines of this length."""
    width = reduce(lambda w, n: F.when(size < n, n // 16).otherwise(w), (256, 128, 64, 32, 16), F.lit(32))
    return size - size % width


def _from_start(i: int, edits: int) -> bool:
    return 2 * i <= edits


def _shifts(i: int, edits: int) -> range:
    """How far segment i may have moved in the longer line, from the end of the line it counts from.

    Some segment i is unchanged with i edits before it and edits - i after it at most. Of lines
    of one length each looks up the other, so one may take the order in which an insertion comes
    before any deletion. Then m places down from the start take 2 * m + 1 edits at least: m to
    come up again, and one more.
    """
    if _from_start(i, edits):
        return range(-min(i, edits - i, (edits - 1) // 2), i + 1)
    return range(-min(i, edits - i), edits - i + 1)


def _with_keys(wide: DataFrame, edits: int, lookup: bool) -> DataFrame:
    """A row (id, size, key) for each segment of a line, or for each place where it looks for one of a line that isn't longer.

    Steps are columns of their own: one expression for all keys is too long to be compiled."""
    parts = edits + 1
    lows = F.array_distinct(F.array(*[_least(F.col("size") - less) for less in range(edits + 1 if lookup else 1)]))
    cut = wide.select("id", "wide", _size().alias("size")).withColumn("low", F.explode(lows))
    cut = cut.select("id", "wide", "size", "low", *[F.expr(f"cast(low * {i} div {parts} as int)").alias(f"cut{i}") for i in range(parts + 1)])

    def key(i: int, shift: int) -> Column:
        start = F.col(f"cut{i}")
        place = start + shift if _from_start(i, edits) else F.col("size") - F.col("low") + start - shift
        return F.xxhash64(_cut(place, F.col(f"cut{i + 1}") - start), "low", F.lit(i))

    keys = F.array(*[key(i, shift) for i in range(parts) for shift in (_shifts(i, edits) if lookup else (0,))])
    return cut.select("id", "size", keys.alias("keys")).select("id", "size", F.explode("keys").alias("key"))


@cache
def _choices(edits: int, matched: int) -> list[tuple[int, ...]]:
    """(length less, segment, shift, segment, shift, ...) of all keys by which a line finds shorter or equal ones.

    Of edits + matched segments some `matched` are unchanged, and they can be chosen so that between
    two of them, before the first and after the last there are no more edits than segments: where
    some segments hold more edits than one each, those next to them are left out as well. An edit
    between two segments belongs to the later one, or to the last. The shift of a segment is what
    edits before it have added up to. Of lines of one length each finds the other, so the first
    shift may be taken as one down only where an insertion and a deletion have gone before.
    """
    parts, found = edits + matched, []
    for less in range(edits + 1):
        for chosen in combinations(range(parts), matched):
            for shifts in product(range(-edits, edits + 1), repeat=matched):
                path, at = (0, *shifts, less), (-1, *chosen, parts)
                moves = [abs(y - x) for x, y in zip(path, path[1:])]
                down = less == 0 and next((s for s in shifts if s), 0) < 0
                if all(m <= j - i - 1 for m, i, j in zip(moves, at, at[1:])) and sum(moves) + 2 * down <= edits:
                    found.append((less, *(x for pair in zip(chosen, shifts) for x in pair)))
    return found


def _finer_keys(signed: DataFrame, edits: int, matched: int, classes: bool, lookup: bool) -> DataFrame:
    """signed with a row for each key of a line, or for each by which it finds lines that aren't longer.

    The segments have the places that they have in the shortest line of the class (each length is
    one unless `classes`), the last counted from the line's end; edits in between belong to it."""
    parts, least = edits + matched, _least if classes else (lambda size: size)
    by_key: dict[tuple[int, ...], int] = {}
    for less, *c in _choices(edits, matched):
        c = tuple(0 if n % 2 and c[n - 1] == parts - 1 else x for n, x in enumerate(c))
        if lookup or not any(c[1::2]):
            by_key[c] = by_key.get(c, 0) | 1 << less
    names = [f"{x}{n}" for n in range(matched) for x in "is"]
    choices = F.array(*[F.struct(F.lit(mask).alias("lesses"), *[F.lit(v).alias(k) for k, v in zip(names, c)]) for c, mask in by_key.items()])
    low = F.col("low")

    def key(c: Column) -> Column:
        cuts = []
        for n in range(matched):
            start, length = _bounds(low, c[f"i{n}"], parts)
            end = F.when(c[f"i{n}"] == parts - 1, F.col("size") - low).otherwise(0)
            cuts += [_cut(start + c[f"s{n}"] + end, length), c[f"i{n}"]]
        return F.xxhash64(*cuts, low)

    reach = range(edits + 1 if lookup else 1)
    each = signed.withColumn("low", F.explode(F.array_distinct(F.array(*[least(F.col("size") - less) for less in reach]))))
    lesses = reduce(lambda x, y: x.bitwiseOR(y), [F.when(least(F.col("size") - less) == low, 1 << less).otherwise(0) for less in reach])
    fitting = let(lesses, lambda x: F.filter(choices, lambda c: c["lesses"].bitwiseAND(x) != 0))
    return each.withColumn("key", F.explode(F.array_distinct(F.transform(fitting, key)))).drop("low", "wide")


def _signature(line: Column) -> Column:
    """Parities of 256 classes of neighbouring characters (pairs) and of 64 classes of characters (ones)."""

    def flip(bits: Column, one: Column, words: int) -> Column:
        bit, word = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(one, F.lit(64)).cast("int")), F.pmod(F.shiftright(one, 6), F.lit(words))
        return F.struct(*[bits[f"w{n}"].bitwiseXOR(F.when(word == n, bit).otherwise(0)).alias(f"w{n}") for n in range(words)])

    def parities(hashes: Column, words: int) -> Column:
        none = F.struct(*[F.lit(0).cast("long").alias(f"w{n}") for n in range(words)])
        return F.aggregate(hashes, none, lambda bits, one: flip(bits, one, words))

    def both(x: Column) -> Column:
        pairs = F.transform(x, lambda c, i: F.xxhash64(c, F.coalesce(F.get(x, i + 1), F.lit(""))))
        return F.struct(parities(pairs, 4).alias("pairs"), parities(F.transform(x, lambda c: F.xxhash64(c)), 1)["w0"].alias("ones"))

    return let(F.split(line, ""), both)


def _may_be_near(a: Column, b: Column, edits: int) -> Column:
    """False only if signature b is out of reach: an edit changes four parities of pairs and two of characters at most."""
    pairs = [F.bit_count(a["pairs"][f"w{n}"].bitwiseXOR(b["pairs"][f"w{n}"])) for n in range(4)]
    return (F.bit_count(a["ones"].bitwiseXOR(b["ones"])) <= 2 * edits) & (reduce(lambda x, y: x + y, pairs) <= 4 * edits)


def _common_start(a: Column, b: Column) -> Column:
    """How many characters both begin with (of the first 65,535), by halving steps."""
    most = F.least(F.length(a), F.length(b))

    def longer(at: Column, step: Column) -> Column:
        same = F.substring(a, at + 1, step) == F.substring(b, at + 1, step)
        return F.when((at + step <= most) & same, at + step).otherwise(at)

    return F.aggregate(F.array(*[F.lit(1 << i) for i in range(15, -1, -1)]), F.lit(0), longer)


def _without_start(x: Column) -> Column:
    """x (a, b) without what both begin with, each read backwards."""

    def cut(at: Column) -> Column:
        return F.struct(*[F.reverse(F.substring(x[c], at + 1, F.length(x[c]))).alias(c) for c in ("a", "b")])

    return let(_common_start(x["a"], x["b"]), cut)


def _like(a: Column, b: Column, edits: int) -> Column:
    """False only if b is out of reach: an edit changes the number of characters other than, say, "e" by one at most."""
    others = [F.length(F.replace(a, F.lit(c), F.lit(""))) - F.length(F.replace(b, F.lit(c), F.lit(""))) for c in " eati"]
    return reduce(lambda x, y: x & y, [F.abs(x) <= edits for x in others])


def within_edits(a: Column, b: Column, edits: int) -> Column:
    """Whether b comes from a by at most `edits` edits. Equal starts and ends are left out first."""

    def rest(x: Column) -> Column:
        sizes = F.greatest(F.length(x["a"]), F.length(x["b"]))
        return F.when(F.least(F.length(x["a"]), F.length(x["b"])) == 0, sizes <= edits).otherwise(_band(x["a"], x["b"], edits))

    near = F.abs(F.length(a) - F.length(b)) <= edits
    return near & let(let(F.struct(a.alias("a"), b.alias("b")), _without_start), lambda x: let(_without_start(x), rest))


def _band(a: Column, b: Column, edits: int) -> Column:
    """Whether b comes from a by at most `edits` edits; neither is empty.

    After t characters of b, bit p of state e says that the first t + p - edits characters of
    a become them by at most e edits.
    """
    band = 2 * edits + 1
    full = (1 << band) - 1

    def mask(one: Column, x: Column, t: Column) -> Column:
        """The places of the band where the other line has the character x."""
        bits = [F.when(F.get(one, t + (p - edits)) == x, F.lit(1 << p)).otherwise(F.lit(0)) for p in range(band)]
        return reduce(lambda u, v: u.bitwiseOR(v), bits)

    def step(state: Column, same: Column) -> Column:
        new = [state["e0"].bitwiseAND(same)]
        for e in range(1, edits + 1):
            before = state[f"e{e - 1}"]
            moved = state[f"e{e}"].bitwiseAND(same).bitwiseOR(before).bitwiseOR(F.shiftright(before, 1))
            new.append(moved.bitwiseOR(F.shiftleft(new[-1], 1)).bitwiseAND(F.lit(full)))
        return F.struct(*[x.alias(f"e{e}") for e, x in enumerate(new)])

    start = F.struct(*[F.lit(((1 << (e + 1)) - 1) << edits & full).alias(f"e{e}") for e in range(edits + 1)])

    def ends(one: Column) -> Column:
        masks = F.transform(F.split(b, ""), lambda x, t: mask(one, x, t))
        return F.aggregate(masks, start, step)[f"e{edits}"]

    apart = F.length(a) - F.length(b)
    return (F.abs(apart) <= edits) & (F.call_function("shiftright", let(F.split(a, ""), ends), apart + edits).bitwiseAND(F.lit(1)) == 1)


def _meetings(index: DataFrame, lookup: DataFrame, crowd: int | None, most_sent: int, hashed: bool, near: Column) -> tuple[DataFrame, DataFrame | None]:
    """Pairs (id, other) that share a key which isn't crowded, and the ids at crowded ones (None if there are none).

    To a lookup, a crowded key is one row without an id."""
    crowded = None
    if crowd is not None:
        hot = stash(index.groupBy("key").count().where(F.col("count") > crowd).select("key"), "line-crowds")
        if n := hot.count():
            crowded = F.broadcast(hot) if n <= most_sent else hot
            in_crowds = index.join(crowded, "key", "left_semi").select("id")
            index = index.join(crowded, "key", "left_anti").unionByName(hot.select("key"), allowMissingColumns=True)
    fits = F.col("id").isNull() | ((F.col("id") != F.col("other")) & near)
    # No key has many rows of the index (but at the last level), so small partitions of it fit hash tables.
    met = stash(lookup.join(index.hint("shuffle_hash") if hashed and crowd is not None else index, "key").where(fits).select("id", "other").distinct(), "line-pairs")
    pairs = met.where("id is not null")
    return pairs, None if crowded is None else in_crowds.unionByName(met.where("id is null").select(F.col("other").alias("id"))).distinct()


def near_lines(lines: DataFrame, edits: int, most_sent: int = 500_000, crowd: int = CROWD, rows: int | None = None) -> DataFrame:
    """lines (line, first) -> first: the places of lines that follow another within reach.

    Where at most `rows` lines, dealt out, leave a task few enough keys, these are joined by hash tables, else by sorting."""
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = rows is not None and rows * (edits + 1) <= tasks * HASHED

    def of(ids: DataFrame, label: str) -> DataFrame:
        ids = stash(ids, label)
        return stash(named.join(F.broadcast(ids) if ids.count() <= most_sent else ids, "id", "left_semi"), f"{label}-texts")

    named = lines.withColumn("id", F.xxhash64("line"))
    wide = named.select("id", _wide(F.col("line")))
    index = stash(_with_keys(wide, edits, False), "line-index")
    lookup = _with_keys(wide, edits, True).withColumnsRenamed({"id": "other", "size": "other_size"})
    alike = F.abs(F.col("size") - F.col("other_size")) <= edits
    pairs, dense = _meetings(index, lookup, crowd if len(_choices(edits, MATCHED[0])) <= MOST_KEYS else None, most_sent, hashed, alike)
    levels = [m for m in MATCHED if len(_choices(edits, m)) <= MOST_KEYS]
    for matched in levels:
        if dense is None:
            break
        signed = of(dense, "line-crowd").select("id", _wide(F.col("line")), _signature(F.col("line")).alias("bits")).withColumn("size", _size())
        last = matched == levels[-1]
        index = _finer_keys(signed, edits, matched, not last, False)
        lookup = _finer_keys(signed, edits, matched, not last, True).withColumnsRenamed({"id": "other", "size": "other_size", "bits": "other_bits"})
        near = alike & _may_be_near(F.col("bits"), F.col("other_bits"), edits)
        more, dense = _meetings(index, lookup, None if last else crowd, most_sent, False, near)
        pairs = pairs.unionByName(more)
    pairs = pairs.select(F.least("id", "other").alias("id"), F.greatest("id", "other").alias("other")).distinct()
    found = of(pairs.select("id").unionByName(pairs.select(F.col("other").alias("id"))).distinct(), "line-wanted")
    both = (
        pairs.join(found.select("id", F.col("line").alias("a"), F.col("first").alias("first_a")), "id")
        .join(found.select(F.col("id").alias("other"), F.col("line").alias("b"), F.col("first").alias("first_b")), "other")
        .where((F.col("a") != F.col("b")) & _like(F.col("a"), F.col("b"), edits) & within_edits(F.col("a"), F.col("b"), edits))
    )
    return both.select(F.greatest("first_a", "first_b").alias("first")).distinct()


def _compared(line: Column, min_chars: int, near_chars: int) -> Column:
    return (F.length(line) >= min_chars) & ((F.length(line) >= near_chars) | line.rlike(r"[^\s]"))


def dedup_lines(documents: DataFrame, edits: int = 2, min_chars: int | None = None, near_chars: int | None = None) -> DataFrame:
    """All rows and columns, with text cut down to the lines that stay, and with line_stats:
    the numbers of lines, of lines equal to an earlier one, and of lines near an earlier one.

    Lines under min_chars (none by default) are left alone, those under near_chars (20, or
    min_chars if that is given) are compared for equality only."""
    if not 1 <= edits <= 8:
        raise ValueError("edits has to be from 1 to 8")
    near_chars = near_chars or min_chars or NEAR_CHARS
    min_chars = min_chars or 1
    split = F.split("text", "\n")
    mark = F.xxhash64("text")
    each = documents.where("doc_id is not null").select("doc_id", mark.alias("mark"), F.posexplode(split).alias("at", "line")).where(_compared(F.col("line"), min_chars, near_chars))
    lines = stash(each.groupBy("line").agg(F.min(F.struct("doc_id", "mark", "at")).alias("first")), "lines")
    near = near_lines(lines.where(F.length("line") >= near_chars), edits, rows=lines.count())
    places = lines.select("first.*", F.lit(False).alias("near")).unionByName(near.select("first.*", F.lit(True).alias("near")))
    kept = places.groupBy(F.col("doc_id").alias("id"), "mark").agg(
        F.collect_set(F.when(~F.col("near"), F.col("at"))).alias("firsts"), F.collect_set(F.when(F.col("near"), F.col("at"))).alias("nears")
    )
    row = documents.select(F.struct(*[c for c in documents.columns if c != "line_stats"]).alias("row"), F.col("doc_id").alias("id"), mark.alias("mark"), split.alias("lines"))
    joined = row.join(kept, ["id", "mark"], "left")
    none = F.array().cast("array<int>")
    compared = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: _compared(F.get("lines", i), min_chars, near_chars))
    whole = F.sequence(F.lit(0), F.size("lines") - 1)
    stays = F.array_sort(F.array_except(whole, F.array_except(F.col("compared"), F.array_except("firsts", "nears"))))
    joined = joined.withColumns({"firsts": F.coalesce("firsts", none), "nears": F.coalesce("nears", none), "compared": compared})
    changed = F.col("id").isNotNull() & F.col("row.text").isNotNull()
    text = F.when(changed, F.array_join(F.transform(stays, lambda i: F.get("lines", i)), "\n")).otherwise(F.col("row.text"))
    stats = F.struct(
        F.when(F.col("row.text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.when(changed, F.size(F.array_except("compared", "firsts"))).otherwise(0).cast("long").alias("n_equal"),
        F.when(changed, F.size(F.array_intersect("compared", "nears"))).otherwise(0).cast("long").alias("n_near"),
    )
    return joined.select("row", text.alias("text"), stats.alias("stats")).select(
        *[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in documents.columns if c != "line_stats"], F.col("stats").alias("line_stats")
    )


def query(spark, sf_dir: str) -> DataFrame:
    done = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return done.select("doc_id", "line_stats.*", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
