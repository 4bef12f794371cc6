"""From the text of a statement to transactions.

Whether a transaction begins at a line, and how many lines it takes, depends on that line and
its neighbours only. A text is cut into chunks of lines, which go to different tasks; these
facts are worked out for each line once. What a walk over the lines has to remember is small:
how many lines are taken (0 to 2) and whether a section is open. So each chunk of a long text is
a function of six states; composing them gives the state before each chunk, and all chunks are
then walked at once. Records are built from the lines where transactions begin, which are
rows with their neighbours. All of it is built-in expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import amounts as A
from ..functions import dates as D
from ..functions.names import clean_merchant, has_letter
from ..functions.scoring import any_of

# Text that opens and closes the list of transactions, and lines without one.
SECTION_START = ["ACCOUNT ACTIVITY", "TRANSACTION HISTORY", "TRANSACTIONS", "POST DATE", "TRANS DATE", "POSTING", "DESCRIPTION OF TRANSACTION"]
SECTION_END = [
    "TOTAL DEBITS", "TOTAL CREDITS", "INTEREST SUMMARY", "FEES SUMMARY", "PAGE 2", "PAGE 3", "PAGE 4", "STATEMENT CLOSING", "IMPORTANT INFORMATION", "OVERDRAFT",
    "DIRECT DEPOSIT", "INTEREST RATE", "DAILY BALANCES", "DAILY BALANCE", "ENDING BALANCE",
]
SUMMARIES = [
    "BEGINNING BALANCE", "ENDING BALANCE", "CREDIT(S) THIS PERIOD", "DEBIT(S) THIS PERIOD", "INTEREST PAID", "ANNUAL PERCENTAGE", "INTEREST DAYS",
    "INTEREST EARNED FROM",
]
HEADERS = ["POST DATE DESCRIPTION", "DATE DESCRIPTION DEBITS", "TRANS DATE", "REFERENCE"]
GARBAGE = [
    "DATE AMOUNT", "DESCRIPTION DEBITS CREDITS", "POST DATE", "TRANS DATE", "REFERENCE", "PAGE", "ACCOUNT STATEMENTS", "STATEMENT ENDING", "CUSTOMER NUMBER",
    "CHECKING ACCOUNT", "SAVINGS ACCOUNT", "DAILY BALANCE", "DATE AMOUNT DATE AMOUNT", "BEGINNING BALANCE", "ENDING BALANCE",
]
BANK_SIGNS = ["CHECKING", "SAVINGS", "ACCOUNT ACTIVITY", "BEGINNING BALANCE", "ENDING BALANCE"]
CARD_SIGNS = ["VISA", "MASTERCARD", "AMEX", "DISCOVER", "CREDIT CARD", "MINIMUM PAYMENT DUE", "CARD ACCOUNT", "STATEMENT CLOSING"]

# What in a statement's first lines, and in its web address, names a bank.
BANK_LINES = [("STEARNSBANK\\.COM|STEARNS BANK", "Stearns Bank"), ("MYMAGNIFI\\.ORG|MAGNIFI FINANCIAL", "Magnifi Financial")]
BANK_DOMAINS = [("stearns", "Stearns Bank"), ("magnifi", "Magnifi Financial"), ("scheels|fnbo", "Scheels Visa")]


def is_garbage(description: Column) -> Column:
    """Headers, footers and fragments that are no transaction."""
    one_word = F.size(F.filter(F.split(description, r"\s+"), lambda w: w != "")) == 1
    return any_of(F.upper(description), GARBAGE) | ((F.length(description) < 4) & one_word) | (F.length(description) < 3) | ~has_letter(description)


def is_credit_card(text: Column) -> Column:
    up = F.upper(text)
    return ~any_of(up, BANK_SIGNS) & any_of(up, CARD_SIGNS)


def bank_name(text: Column) -> Column:
    """From the first fifty lines, else from the first web address, else from a brand, else "Unknown"."""
    brand = F.contains(F.upper(text), F.lit("SCHEELS"))

    def of_line(line: Column) -> Column:
        out = F.when(line.rlike(BANK_LINES[0][0]), F.lit(BANK_LINES[0][1]))
        for pattern, name in BANK_LINES[1:]:
            out = out.when(line.rlike(pattern), F.lit(name))
        issued = F.when(brand, F.lit("Scheels Visa")).otherwise(F.lit("First National Bank of Omaha"))
        return out.when(F.contains(line, F.lit("ISSUED BY")) & F.contains(line, F.lit("FIRST NATIONAL BANK")), issued)

    # Of each line that may name a bank, what begins at the first such place.
    signs = "|".join([*(pattern for pattern, _ in BANK_LINES), "ISSUED BY", "FIRST NATIONAL BANK"])
    ends = F.regexp_extract_all(F.upper(F.substring_index(text, "\n", 50)), F.lit(rf"(?:{signs})[^\n]*"), 0)
    lines = F.transform(ends, of_line)
    domain = F.regexp_extract(F.lower(text), r"www\.([a-z0-9-]+)\.(com|org|net)", 1)
    by_domain = F.lit(None).cast("string")
    for pattern, name in reversed(BANK_DOMAINS):
        by_domain = F.when(domain.rlike(pattern), F.lit(name)).otherwise(by_domain)
    by_brand = F.when(brand & F.upper(text).rlike("VISA|CARD"), F.lit("Scheels Visa"))
    return F.coalesce(F.get(F.filter(lines, lambda x: x.isNotNull()), 0), by_domain, by_brand, F.lit("Unknown"))


def _dated(line: Column) -> Column:
    return line.rlike(D.ANY_DATE)


FULL_DATE = r"^\d{1,2}/\d{1,2}/\d{4}"
CHUNK = 512  # lines

# What is known of a line by itself, as bits.
DATED, FULL, LETTER, DOLLAR, BLANK, OPENS, CLOSES, OTHER, LOOSE = (1 << i for i in range(9))


def once(rows: DataFrame, *keep: str | Column, **columns: Column) -> DataFrame:
    """keep and further columns, each worked out once however often later steps name them: filters and
    projections aren't moved through a generator."""
    return rows.select(*keep, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _marks(line: Column) -> Column:
    up = F.upper(line)
    lists = [(SECTION_START, OPENS), (SECTION_END, CLOSES), (SUMMARIES + HEADERS, OTHER)]

    def bits(*tests: tuple[Column, int]) -> Column:
        return reduce(lambda x, y: x + y, [F.when(test, bit).otherwise(0) for test, bit in tests])

    # Each of these dates begins like the one before it, and few lines hold a word of any list.
    dates = F.when(line.rlike(r"^\d{1,2}[/-]\d{1,2}"), bits((line.rlike(D.ANY_DATE), DATED), (line.rlike(FULL_DATE), FULL)) + LOOSE).otherwise(0)
    words = F.when(any_of(up, [w for ws, _ in lists for w in ws]), bits(*[(any_of(up, ws), bit) for ws, bit in lists])).otherwise(0)
    return bits((has_letter(line), LETTER), (F.contains(line, F.lit("$")), DOLLAR), (line == "", BLANK)) + dates + words


def _has(marks: Column, bit: int) -> Column:
    return marks.bitwiseAND(bit) != 0


def _continues(marks: Column, date: int) -> Column:
    """Whether a line goes on with the description before it: text without a date (of this form) or a dollar sign."""
    return marks.bitwiseAND(BLANK | date | LETTER | DOLLAR) == LETTER


def _steps(marks: Column, own: Column, before: Column, part: Column) -> Column:
    """What each line of a chunk does to a state without lines to skip, outside a section (four bits) and inside (the next
    four): the state after it, and 8 if a transaction begins there."""

    def one(here: Column, i: Column) -> Column:
        after, third = (F.coalesce(F.get(marks, before + i + n), F.lit(BLANK)) for n in (1, 2))
        amounts = F.size(A.extract_amounts(D.skip_date(F.get(part, before + i + 1)))) > 0
        # How many lines a transaction takes that begins here.
        plain = (
            F.when(~_has(here, LETTER) | ~_has(after, FULL), 1).when(~amounts, 2)
            .when(_continues(third, FULL), 3).otherwise(2)
        )
        takes = F.when(_has(here, BLANK), 1).when(_has(here, DATED), F.when(_continues(after, DATED), 2).otherwise(1)).otherwise(plain)
        begins = 6 + takes * 2
        inside = F.when(_has(here, CLOSES), 0).when(_has(here, OTHER), 16).otherwise((begins + 1) * 16)
        outside = F.when(_has(here, OTHER) | ~_has(here, LOOSE), 0).otherwise(begins)
        return F.when(_has(here, OPENS), 1 + 16).otherwise(inside + outside)

    return F.transform(own, one)


def _after(state: Column, x: Column) -> Column:
    """The state after a line, and 8 if a transaction begins there; a state is 2 * lines to skip + whether a section is open."""
    return F.when(state > 1, state - 2).when(state == 1, F.shiftright(x, 4)).otherwise(x.bitwiseAND(15))


def _exit(steps: Column, start: int) -> Column:
    """The state after a chunk, from a state before it."""
    return F.aggregate(steps, F.lit(start), lambda state, x: _after(state, x).bitwiseAND(7))


def _heads(steps: Column, entry: Column) -> Column:
    """The places in a chunk where a transaction may begin."""
    start = F.struct(F.lit(0).alias("at"), entry.cast("int").alias("state"), F.array().cast("array<int>").alias("heads"))

    def step(acc: Column, x: Column) -> Column:
        after = _after(acc["state"], x)
        heads = F.when(_has(after, 8), F.concat(acc["heads"], F.array(acc["at"]))).otherwise(acc["heads"])
        return F.struct((acc["at"] + 1).alias("at"), after.bitwiseAND(7).alias("state"), heads.alias("heads"))

    return F.aggregate(steps, start, step)["heads"]


def _chunks(texts: DataFrame, default_year: int, size: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """Texts as chunks of lines, each with a line of the chunk before it and two of the next, and the steps of its own lines."""
    year, kept = D.statement_year(F.col("text"), default_year), ("doc_id", *carry)
    read = once(texts.where("text is not null"), *kept, key=F.xxhash64("doc_id", "text"), year=year, lines=F.transform(F.split("text", "\n"), lambda x: F.trim(x)))
    last = F.floor((F.size("lines") - 1) / size).cast("int")

    def part(c: Column) -> Column:
        before = F.when(c > 0, 1).otherwise(0)
        return F.struct(c.alias("chunk"), before.alias("before"), F.slice("lines", c * size + 1 - before, size + 2 + before).alias("part"))

    spread = read.select(*kept, "key", "year", F.inline(F.transform(F.sequence(F.lit(0), last), part)))
    marked = once(spread, *kept, "key", "year", "chunk", "before", "part", marks=F.transform("part", _marks))
    own = F.slice("marks", F.col("before") + 1, F.lit(size))
    return once(marked, *kept, "key", "year", "chunk", "before", "part", steps=_steps(F.col("marks"), own, F.col("before"), F.col("part")))


def _entries(chunks: DataFrame) -> DataFrame:
    """key, chunk and the state before it, for chunks of long texts.

    A chunk is a function from the state before it to the one after it; they are composed in the
    order of chunks, which are few numbers for each text.
    """
    each = chunks.select("key", "chunk", F.array(*[_exit(F.col("steps"), s) for s in range(6)]).alias("f")).groupBy("key", "chunk").agg(F.first("f").alias("f"))
    whole = each.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("chunk", "f"))).alias("all"))
    start = F.struct(F.lit(0).alias("state"), F.array().cast("array<int>").alias("entries"))
    walked = F.aggregate("all", start, lambda acc, x: F.struct(F.get(x["f"], acc["state"]).alias("state"), F.concat(acc["entries"], F.array(acc["state"])).alias("entries")))
    return whole.select("key", F.posexplode(walked["entries"]).alias("chunk", "entry"))


def parse_statements(texts: DataFrame, default_year: int, signed: bool = True, clean: bool = True, chunk: int = CHUNK, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns to carry along, line_no, txn_date_raw, txn_date, place, place_original, amount, debits, credits, balance, from doc_id and text.

    One amount is the transaction's; of two, the second is the balance; of three, the first two
    are debit and credit. signed keeps minus signs and CR, and also fills amount from debit or
    credit; without it rows look like those of older ledgers. Without clean, place is left null, for
    a caller that cleans the different names once each.
    """
    kept = ("doc_id", *carry)
    many = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) >= chunk
    # Texts of one chunk begin in the first state, so only long ones go through the shuffles of a join.
    short, long = (_chunks(texts.where(test), default_year, chunk, carry) for test in (~many, many))
    entered = short.withColumn("entry", F.lit(0)).unionByName(long.join(_entries(long), ["key", "chunk"]))
    begun = once(entered, *kept, "year", "chunk", "before", "part", heads=_heads(F.col("steps"), F.col("entry")))

    def around(i: Column) -> Column:
        near = [F.coalesce(F.get("part", F.col("before") + i + n), F.lit("")).alias(name) for n, name in ((-1, "prior"), (0, "here"), (1, "after"), (2, "third"))]
        return F.struct((F.col("chunk") * chunk + i).alias("at"), *near)

    heads = begun.select(*kept, "year", F.inline(F.transform("heads", around)))
    here, before, after, third = (F.col(c) for c in ("here", "prior", "after", "third"))
    near = ("prior", "here", "after", "third")

    def follows(line: Column, date: Column) -> Column:
        return (line != "") & ~F.contains(line, F.lit("$")) & ~date & has_letter(line)

    # Later steps name the earlier ones several times.
    known = once(heads, *kept, "year", "at", *near, dated=_dated(here), second=D.skip_date(here))
    dated, second = F.col("dated"), F.col("second")
    rest = F.trim(F.regexp_replace(F.when(_dated(second), D.skip_date(second)).otherwise(second), r"^\d{17,}\s+", ""))
    raw = F.when(dated, D.leading_date(here, F.col("year"))).otherwise(F.regexp_extract(after, f"({FULL_DATE[1:]})", 1))
    known = once(known, *kept, "at", *near, "dated", rest=F.when(dated, rest), raw=raw)
    rest = F.col("rest")
    known = once(known, *kept, "at", *near, "dated", "rest", "raw", stripped=A.strip_amounts(rest))
    own = F.col("stripped")
    poor = (F.length(own) < 3) | ~has_letter(own)
    usable = ~_dated(before) & ~before.rlike(r"^\d{1,2}:\d{2}$") & has_letter(before) & (F.length(before) > 5)
    own = F.when(poor & usable, before).otherwise(own)
    dated_text = F.when(follows(after, _dated(after)), F.concat(own, F.lit(" "), after)).otherwise(own)

    amounts_line = D.skip_date(after)
    plain = F.regexp_replace(here, r"\s+\d{1,2}/\d{1,2}/\d{2,4}$", "")
    plain_text = F.when(follows(third, third.rlike(FULL_DATE)), F.concat(plain, F.lit(" "), third)).otherwise(plain)

    raw = F.when(dated, D.repair_month(F.col("raw"))).otherwise(F.col("raw"))
    found = (A.signed_amounts if signed else A.extract_amounts)(F.when(dated, rest).when(after.rlike(FULL_DATE), amounts_line))
    description = F.trim(F.regexp_replace(F.when(dated, dated_text).otherwise(plain_text), r"\s+", " "))
    rows = once(known, *kept, F.col("at").alias("line_no"), txn_date_raw=raw, place_original=description, found=found)
    rows = rows.where((F.size("found") > 0) & (F.col("place_original") != "") & ~is_garbage(F.col("place_original")))
    n, none = F.size("found"), F.lit(None).cast(A.MONEY)
    debits = F.when((n >= 3) & (F.get("found", 0) > 0), F.get("found", 0))
    credits = F.when((n >= 3) & (F.get("found", 1) > 0), F.get("found", 1))
    amount = F.when(n < 3, F.get("found", 0)).otherwise(F.coalesce(debits, credits) if signed else none)
    return rows.select(
        *kept, "line_no", "txn_date_raw", D.to_date(F.col("txn_date_raw")).alias("txn_date"), (clean_merchant(F.col("place_original")) if clean else F.lit(None).cast("string")).alias("place"), "place_original",
        amount.alias("amount"), debits.alias("debits"), credits.alias("credits"), F.when(n == 2, F.get("found", 1)).when(n >= 3, F.get("found", 2)).alias("balance"),
    )
