"""The monthly run: from statements to ledgers, as one plan of DataFrames."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import clean_place
from ..operators import categorize, classify, merchants, reconcile, review, statements, transfers
from ..schema import LEARNED, LEDGER, MERCHANT_CACHE, REVIEW, REVIEW_LOG
from ..session import stash
from ..sources import keywords, sinks
from ..sources.providers import TextProvider


LEDGER_COLUMNS = [c.split(" ")[0] for c in LEDGER.split(", ")]


@dataclass
class Settings:
    year: int
    categories: dict[str, list[str]] = field(default_factory=lambda: dict(keywords.CATEGORIES))
    income: list[str] = field(default_factory=lambda: list(keywords.INCOME))
    transfers: list[str] = field(default_factory=lambda: list(keywords.TRANSFERS))
    transfer_days: int = 2
    strict: bool = False
    provider: TextProvider | None = None
    holders: tuple[str, ...] = ()  # first names of account holders
    adviser: TextProvider | None = None  # asked about kinds, categories and labels where rules don't tell


def parse_month(texts: DataFrame, settings: Settings, cache: DataFrame | None = None) -> DataFrame:
    """Statement texts (doc_id, extractor A or B, text, month) -> one ledger with a type for each row.

    The two extractions of a document are reconciled by their dates as printed; rows of documents
    that only one could read come from that one. Transfers by their words and noise are left out.
    txn_id tells equal purchases apart and follows the order of documents, dates and lines.
    """
    texts = stash(texts.select("doc_id", "extractor", "text", "month"), "texts")  # several steps read them
    bank = F.struct(statements.bank_name(F.col("text")).alias("statement"), (~statements.is_credit_card(F.col("text"))).alias("is_bank_account"))
    about = texts.groupBy("doc_id").agg(F.max_by(bank, F.length("text")).alias("bank"), F.max("month").alias("month")).select("doc_id", "month", "bank.*")
    # Parsing takes far longer than reading, and files are few and small: several tasks a core keep all cores at work to the end.
    spread = texts.where(F.col("extractor").isin("A", "B")).repartition(4 * texts.sparkSession.sparkContext.defaultParallelism, "doc_id", "extractor")
    # The parser is one large expression: filters pushed into it would repeat it.
    parsed = stash(statements.parse_statements(spread, settings.year, signed=not settings.strict, clean=False, carry=("extractor",)), "parsed")
    a, b = (parsed.where(F.col("extractor") == name).drop("extractor") for name in "AB")
    rows = reconcile.reconcile(a, b, keys=("doc_id", "txn_date_raw"), order="line_no", carry=("line_no", "txn_date", "debits", "credits", "balance"))
    rows = stash(rows.where(F.coalesce("amount", "debits", "credits").isNotNull()), "reconciled")  # read for its names, and then for its rows
    rows = merchants.clean_names(rows, cache, settings.provider, holders=settings.holders, then=clean_place)
    rows = rows.join(about, "doc_id").where(~transfers.is_transfer(F.col("place_original"), F.col("place"), settings.transfers))
    if settings.adviser is not None:
        rows = classify.ask_kinds(stash(rows, "unasked"), settings.adviser, settings.income, settings.strict)
    advice = F.col("advice") if settings.adviser is not None else None
    kind = classify.transaction_type(F.col("is_bank_account"), F.col("amount"), F.col("debits"), F.col("credits"), F.col("place_original"), settings.income, settings.strict, advice)
    rows = rows.withColumn("type", kind).drop("advice").where(F.col("type").isNotNull() & review.not_blank(F.col("place")))
    rows = rows.where(~classify.is_noise(F.col("place"), F.col("type"), settings.strict))
    late = F.when(F.col("extraction_method") == "B only", "1").otherwise("0")
    name = F.concat_ws("/", "doc_id", F.coalesce("txn_date_raw", F.lit("")), late, F.lpad(F.col("line_no").cast("string"), 9, "0"))
    return rows.withColumn("txn_id", name).withColumn("account_id", F.col("statement"))


def build_month(ledger: DataFrame, settings: Settings, entries: DataFrame | None = None, reviewed: DataFrame | None = None) -> dict[str, DataFrame]:
    """Expenses, income and review of a ledger, without rows that are two sides of one transfer.

    entries: hand-written rows as review.manual_entries gives them; those that are ok are expenses,
    under the category that they were given. reviewed: rows of an earlier review with the decisions
    of people; decided ones move to their ledgers with their corrected categories, open ones stay.
    A row of an earlier review isn't put up for review again.
    """
    candidates = ledger if not settings.strict else ledger.where("type = 'Expense'")
    chosen = transfers.greedy_transfers(candidates, settings.transfer_days, "account_id")
    kept = stash(transfers.without_pairs(ledger, chosen), "kept").withColumn("manual", F.lit(False))  # three ledgers read it
    if entries is not None:
        id_ = [c for c in ("txn_id",) if c in entries.columns]
        own = entries.where("status = 'ok'").select(*id_, "txn_date", "place", "amount", "category", F.lit("Expense").alias("type"), F.lit(True).alias("manual"))
        kept = kept.unionByName(own, allowMissingColumns=True)
    by_hand, automatic = classify.split(kept, F.col("manual"))
    labelled = categorize.categorize(automatic.drop("manual"), settings.categories)
    if settings.adviser is not None:
        labelled = categorize.ask_categories(stash(labelled, "unlabelled"), settings.categories, settings.adviser)
    out = review.route(labelled, settings.strict)
    if entries is not None:
        unknown, known = classify.split(by_hand.drop("manual"), F.coalesce("category", F.lit(categorize.UNCATEGORIZED)) == categorize.UNCATEGORIZED)
        out["expenses"] = out["expenses"].unionByName(known)
        out["review"] = out["review"].unionByName(unknown.withColumns({"uncategorized": F.lit(True), "classification": F.lit("")}))
    if reviewed is not None:
        valid = review.with_valid_categories(reviewed, list(settings.categories), settings.adviser).drop("is_valid")
        known = reviewed.select("txn_id").where("txn_id is not null").distinct()
        new = {name: rows.join(known, "txn_id", "left_anti") for name, rows in out.items()}
        merged = review.apply_review(new["expenses"], new["income"], valid)
        out = merged | {"review": new["review"].unionByName(merged["review"], allowMissingColumns=True)}
    return out


def learned(settings: Settings, entries: DataFrame | None = None, reviewed: DataFrame | None = None) -> DataFrame | None:
    """category and keyword of what people decided: uncategorized rows of a review, and their own entries."""
    valid, found = list(settings.categories), []
    if reviewed is not None:
        found.append(review.learned_keywords(reviewed.where("coalesce(uncategorized, false)"), valid))
    if entries is not None:
        rows = entries.where(F.col("is_valid") & (F.col("status") == "ok") & (F.col("category") != categorize.UNCATEGORIZED))
        found.append(rows.select("category", F.lower(F.trim("place")).alias("keyword")).distinct())
    return reduce(DataFrame.unionByName, found) if found else None


def with_learned(settings: Settings, words: DataFrame) -> Settings:
    """Settings whose categories have the keywords (category, keyword) too, behind their own."""
    more: dict[str, list[str]] = {}
    for r in words.orderBy("category", "keyword").collect():  # what people have typed
        more.setdefault(r["category"], []).append(r["keyword"])
    return replace(settings, categories={c: [*ks, *[k for k in more.get(c, []) if k not in {x.lower() for x in ks}]] for c, ks in settings.categories.items()})


def history(spark, root: str) -> DataFrame:
    """place, ordinal and month of the current expenses and income of all months below root, as close_month() writes them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    months = sorted(f.getPath().getName() for f in store.listStatus(path) if re.fullmatch(r"\d{4}-\d{2}", f.getPath().getName())) if store.exists(path) else []
    out = spark.createDataFrame([], "place string, month string, ordinal struct<month:string,file:int,row:long>")
    for month in months:
        for n, name in enumerate(("expenses", "income")):
            rows = sinks.MonthStore(spark, root, month).read(name, "place string").where("place is not null")
            ordinal = F.struct(F.lit(month).alias("month"), F.lit(n).alias("file"), F.monotonically_increasing_id().alias("row"))
            out = out.unionByName(rows.select("place", F.lit(month).alias("month"), ordinal.alias("ordinal")))
    return out


def close_month(
    texts: DataFrame | None, month: str, root: str, settings: Settings, cache_path: str, entries: DataFrame | None = None, reviewed: DataFrame | None = None,
    keywords_path: str | None = None, corrections: DataFrame | None = None, rebuild: bool = True,
) -> dict[str, bool]:
    """A month from statements to tables below root/month, as one commit (sinks.MonthStore): expenses,
    income (if there is any), review (if something is open), and the ledger and log to go on from.

    Without texts the ledger of the run before is taken. Entries and decisions are kept in the log,
    so those of earlier runs count in every later one; of two about the same row the later counts.
    Two phases: what people decided and typed is gathered first, in this run and in those before:
    keywords go to keywords_path, and names of all months' ledgers (and corrections: place,
    ordinal) into the cache, over older ones; then the month is cleaned and categorised with both.
    Without rebuild, a month that is there already stays as it is. Returns what was written.
    """
    spark = (texts if texts is not None else entries if entries is not None else reviewed).sparkSession
    store = sinks.MonthStore(spark, root, month)
    if not rebuild and store.current() is not None:
        return {}
    log = store.read("log", REVIEW_LOG)
    at = (log.agg(F.max("at")).first()[0] or 0) + 1
    records = [log]
    if entries is not None:
        records.append(review.log_entries(entries, at))
    if reviewed is not None:
        records.append(review.log_decisions(reviewed, at))
    typed = [c.rsplit(" ", 1) for c in REVIEW_LOG.split(", ")]
    log = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), records)
    log = stash(log.select(*[F.col(c).cast(kind) for c, kind in typed]), "log")
    counts = stash(review.fold(log), "folded")
    own = counts.where("kind = 'entry'").withColumn("status", F.lit("ok"))
    # What is still open comes from the ledger and the entries anew; only rows that people added have nothing else.
    closed = review.review_state(F.col("classification")).isin("income", "expense") | F.col("txn_id").startswith("added/")
    decided = review.with_valid_categories(counts.where((F.col("kind") == "decision") & closed).select(*[c.rsplit(" ", 1)[0] for c in REVIEW.split(", ")]), list(settings.categories), settings.adviser).drop("is_valid")

    words = learned(settings, own, decided)
    if keywords_path:
        known = sinks.read_dictionary(spark, keywords_path, LEARNED)
        words = stash(keywords.learn_keywords(known, words), "keywords")
    settings = with_learned(settings, words)
    names = merchants.learn_names(history(spark, root).select("place", "ordinal"))
    if corrections is not None:
        names = merchants.merge_cache(names, merchants.learn_names(corrections))
    cache = stash(merchants.merge_cache(sinks.read_dictionary(spark, cache_path, MERCHANT_CACHE), names), "cache")

    ledger = store.read("ledger", LEDGER) if texts is None else parse_month(texts, settings, cache).select(*LEDGER_COLUMNS)
    ledger = stash(ledger, "ledger")
    out = {name: stash(rows, name) for name, rows in build_month(ledger, settings, own, decided).items()}
    written = store.commit({**out, "ledger": ledger, "log": log})
    # The cache and the keywords hold nothing that the month lacks, so a failure here loses nothing.
    sinks.write_dictionary(merchants.merge_cache(cache, merchants.used_names(ledger)), cache_path)
    if keywords_path:
        sinks.write_dictionary(words, keywords_path)
    return {name: written[name] for name in ("expenses", "income", "review")}
