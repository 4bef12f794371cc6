"""The ledger queries by name, and DuckDB SQL with the same results.

Queries run over whole tables. Orders, line items and events stand for ledgers
(sources/adapters.py); where an operator works on text, texts are printed from those rows (see
also texts.py).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import amounts, dates, names, scoring
from ..operators import categorize, classify, merchants, reconcile, review, rollup, statements, transfers
from ..sources import adapters, keywords, providers
from . import monthly, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

ANCHOR = "2001-08-02"
DICTIONARY = {"Hardware": ["bolt", "gear", "rod"], "Jewelry": ["ring"], "Heavy": ["anvil", "hot"], "Colour": ["red", "blue"]}
CASE = """case when regexp_matches(lower(p_name), 'bolt|gear|rod') then 'Hardware' when contains(lower(p_name), 'ring') then 'Jewelry'
  when regexp_matches(lower(p_name), 'anvil|hot') then 'Heavy' when regexp_matches(lower(p_name), 'red|blue') then 'Colour' else 'Uncategorized' end"""
LL = f"""ll as (select cast(l_shipdate as date) as txn_date, strftime(l_shipdate, '%Y-%m') as month, p_name as place, l_returnflag as statement,
  cast(l_extendedprice as decimal(12,2)) as amount, {CASE} as category from lineitem join part on l_partkey = p_partkey)"""
LO = """lo as (select o_orderkey as txn_id, cast(o_orderdate as date) as txn_date, strftime(o_orderdate, '%Y-%m') as month, o_orderpriority as place,
  o_orderstatus as statement, cast(o_totalprice as decimal(12,2)) as amount from orders)"""
LE = """le as (select event_id as txn_id, cast(ts as date) as txn_date, cast(value as decimal(12,2)) as amount, event_type as statement,
  event_type || ' ' || user_id as place from events)"""


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def spending(spark: SparkSession, sf: str) -> DataFrame:
    return categorize.categorize(adapters.line_items(spark, sf), DICTIONARY)


# Rollups


@query(f"with {LL} select month, category, cast(sum(amount) as double) as amount from ll group by all")
def monthly_category_expenses(spark, sf):
    return rollup.by_month_and_category(spending(spark, sf)).withColumn("amount", F.col("amount").cast("double"))


@query(f"with {LL} select category, cast(sum(amount) as double) as total, count(amount) as n, round(cast(sum(amount) as double) / count(amount), 2) as mean from ll group by all")
def category_summary(spark, sf):
    return rollup.category_summary(spending(spark, sf)).select("category", F.col("total").cast("double").alias("total"), "n", F.round(F.col("total").cast("double") / F.col("n"), 2).alias("mean"))


@query(f"with {LO} select month, cast(sum(amount) as double) as income from lo where month between '2000-09' and '2001-08' group by month")
def income_by_month_last12(spark, sf):
    return rollup.by_month(rollup.recent_months(adapters.orders(spark, sf), ANCHOR), "income").withColumn("income", F.col("income").cast("double"))


@query(f"with {LL} select category, cast(sum(amount) as double) as amount from ll where month = '2001-07' group by all")
def prev_month_categories(spark, sf):
    rows = spending(spark, sf)
    month = rows.where(F.col("month") == dates.previous_month(F.lit(ANCHOR).cast("date")))
    return rollup.by_category(month, "2001-07").withColumn("amount", F.col("amount").cast("double"))


@query(f"""with {LL} select month, {', '.join(f"cast(coalesce(sum(amount) filter (category = '{c}'), 0) as double) as {c}" for c in [*DICTIONARY, 'Uncategorized'])},
  cast(sum(amount) as double) as total from ll group by month""")
def month_category_pivot(spark, sf):
    out = rollup.month_category_pivot(spending(spark, sf), [*DICTIONARY, "Uncategorized"])
    return out.select("month", *[F.col(c).cast("double").alias(c) for c in out.columns if c != "month"])


@query(f"""with {LL}, {LO}, e as (select month, sum(amount) as expense from ll group by month), i as (select month, sum(amount) as income from lo group by month)
  select month, cast(expense as double) as expense, cast(coalesce(income, 0) as double) as income, cast(coalesce(income, 0) - expense as double) as savings from e left join i using (month)""")
def income_vs_expense_savings(spark, sf):
    out = rollup.savings(adapters.line_items(spark, sf), adapters.orders(spark, sf))
    return out.select("month", *[F.col(c).cast("double").alias(c) for c in ("expense", "income", "savings")])


@query(f"""with {LL}, {LO}, e as (select sum(amount) as total_expenses, count(distinct category) as n_categories, sum(amount) filter (month = '2001-07') as m from ll),
  i as (select sum(amount) as total_income, count(distinct month) as n_months from lo)
  select cast(total_expenses as double) as total_expenses, cast(total_income as double) as total_income, n_months, n_categories,
  round(cast(total_income as double) / n_months, 2) as avg_income, round(cast(total_income as double) / n_months - cast(coalesce(m, 0) as double), 2) as avg_savings from e, i""")
def kpi_cards(spark, sf):
    out = rollup.totals(spending(spark, sf), adapters.orders(spark, sf), "2001-07")
    return out.withColumns({c: F.col(c).cast("double") for c in ("total_expenses", "total_income")})


@query(f"""with {LL}, c as (select category, sum(amount) as amount from ll group by category)
  select category, cast(amount as double) as amount, round(cast(amount as double) * 100 / cast(sum(amount) over () as double), 4) as percent from c""")
def percent_of_total(spark, sf):
    rows = rollup.category_summary(spending(spark, sf)).select("category", F.col("total").alias("amount"))
    return rollup.with_share(rows).withColumn("amount", F.col("amount").cast("double"))


@query(f"with {LL} select place, cast(sum(amount) as double) as amount from ll group by place order by sum(amount) desc, place limit 8")
def top_k_categories(spark, sf):
    rows = adapters.line_items(spark, sf).groupBy("place").agg(F.sum("amount").alias("amount"))
    return rollup.top_k(rows, 8, tie="place").withColumn("amount", F.col("amount").cast("double"))


@query(f"""with {LL}, c as (select count(*) as total, count(*) filter (category <> 'Uncategorized') as categorized from ll)
  select total, categorized, total - categorized as uncategorized, round(categorized * 100 / total, 2) as categorized_pct, round((total - categorized) * 100 / total, 2) as uncategorized_pct from c""")
def categorization_report(spark, sf):
    return rollup.report(spending(spark, sf))


@query(f"with {LL} select place, count(*) as n, cast(sum(amount) as double) as amount from ll where category = 'Uncategorized' group by place")
def uncategorized_merchants(spark, sf):
    return rollup.uncategorized_merchants(spending(spark, sf)).withColumn("amount", F.col("amount").cast("double"))


@query("select event_type as model, count(*) as total, round(sum(case when value >= 50 then 1 else 0 end) * 100 / count(*), 2) as accuracy, round(avg(value), 4) as mean_seconds, "
       "event_type = (select event_type from events group by 1 order by round(sum(case when value >= 50 then 1 else 0 end) * 100 / count(*), 2) desc, round(avg(value), 4), event_type desc limit 1) as is_best, "
       "event_type = (select event_type from events group by 1 order by round(avg(value), 4), event_type limit 1) as is_fastest from events group by event_type")  # fmt: skip
def model_leaderboard(spark, sf):
    t = spark.read.parquet(f"{sf}/events.parquet")
    return rollup.leaderboard(t.select(F.col("event_type").alias("model"), (F.col("value") >= 50).cast("int").alias("correct"), F.col("value").alias("seconds")))


@query(f"with {LO} select txn_id, cast(txn_date as varchar) as txn_date, row_number() over (order by txn_date nulls last, txn_id) as place_in_order from lo order by txn_date nulls last, txn_id limit 500")
def chrono_sort(spark, sf):
    first = rollup.chronological(adapters.orders(spark, sf), "txn_id").limit(500)  # the oldest 500, as a report shows them
    order = F.row_number().over(Window.orderBy(F.asc_nulls_last("txn_date"), "txn_id"))
    return first.select("txn_id", F.col("txn_date").cast("string").alias("txn_date"), order.cast("long").alias("place_in_order"))


@query(f"with {LO} select txn_id, cast(txn_date as varchar) as txn_date, row_number() over (order by txn_date nulls last, txn_id) as place_in_order from lo")
def chrono_sort_all(spark, sf):
    """The whole ledger: a row's place is its place on its day after the rows of all days before."""
    rows = adapters.orders(spark, sf).select("txn_id", "txn_date")
    days = rows.groupBy(F.col("txn_date").alias("day")).count()
    before = F.sum("count").over(Window.orderBy(F.asc_nulls_last("day"))) - F.col("count")  # one row for each day
    ranked = rows.withColumn("at", F.row_number().over(Window.partitionBy("txn_date").orderBy("txn_id")))
    placed = ranked.join(F.broadcast(days.select("day", before.alias("before"))), F.col("txn_date").eqNullSafe(F.col("day")))
    return placed.select("txn_id", F.col("txn_date").cast("string").alias("txn_date"), (F.col("before") + F.col("at")).cast("long").alias("place_in_order"))


@query(f"with {LO} select distinct month, strftime(date_trunc('month', txn_date) - interval 1 month, '%Y-%m') as previous from lo")
def months_seen(spark, sf):
    rows = adapters.orders(spark, sf)
    return rows.select("month", dates.previous_month(F.col("txn_date")).alias("previous")).distinct()


# Categories


@query(f"with {LL} select place, category, count(*) as n from ll group by all")
def keyword_first_match(spark, sf):
    table = keywords.category_table(spark, DICTIONARY)
    rows = categorize.categorize_by_table(adapters.line_items(spark, sf), table)
    return rows.groupBy("place", "category").agg(F.count("*").alias("n"))


@query("""with words as (select c_nationkey as cat_order, 'nation ' || c_nationkey as category, c_custkey as kw_order, kind || ' ' || c_custkey as keyword
    from customer, (values ('CLICK'), ('error')) t(kind) where c_custkey % 7 <> 0),
  places as (select event_type || ' ' || user_id as place, count(*) as n from events group by 1),
  found as (select place, first(category order by cat_order, kw_order) as category from places join words on contains(lower(place), lower(keyword)) group by place)
  select place, coalesce(category, 'Uncategorized') as category, n from places left join found using (place)""")
def large_dictionary_match(spark, sf):
    """A dictionary with two keywords for each customer, many of which are part of others; from 1,000 keywords on it is joined."""
    customers = spark.read.parquet(f"{sf}/customer.parquet").where("c_custkey % 7 <> 0")
    keyword = F.explode(F.array(*[F.concat_ws(" ", F.lit(kind), "c_custkey") for kind in ("CLICK", "error")]))
    nation = F.concat_ws(" ", F.lit("nation"), "c_nationkey")
    table = customers.select(F.col("c_nationkey").alias("cat_order"), nation.alias("category"), F.col("c_custkey").alias("kw_order"), keyword.alias("keyword"))
    rows = categorize.categorize_by_table(adapters.events(spark, sf), table, most_sent=1_000)
    return rows.groupBy("place", "category").agg(F.count("*").alias("n"))


@query(f"""with {LL} select place, case {' '.join(f"when contains(lower(place), '{k}') then '{k}'" for ks in DICTIONARY.values() for k in ks)} end as keyword, count(*) as n from ll group by all""")
def deciding_keyword(spark, sf):
    rows = adapters.line_items(spark, sf).withColumn("keyword", categorize.keyword_of(F.col("place"), DICTIONARY))
    return rows.groupBy("place", "keyword").agg(F.count("*").alias("n"))


MIXED = "case o_orderstatus when 'F' then 'hardware' when 'O' then 'JEWELRY' else 'nothing' end"


@query(f"""select label, case label when 'hardware' then 'Hardware' when 'JEWELRY' then 'Jewelry' when '' then 'Uncategorized' else label end as category, label <> 'nothing' as is_valid
  from (select distinct {MIXED} as label from orders union select '')""")
def category_validation_exact(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet").select(F.expr(MIXED).alias("label")).unionByName(spark.range(1).select(F.lit("").alias("label")))
    return categorize.correct_categories(rows, list(DICTIONARY))


@query("""with known as (select 'Hardware' as category, p_name as keyword from part where p_partkey % 3 = 0), learned as (select 'Hardware' as category, upper(p_name) as keyword from part)
  select category, keyword from known union all
  select category, min(keyword) from learned l where not exists (select 1 from known k where k.category = l.category and lower(k.keyword) = lower(l.keyword)) group by category, lower(keyword)""")
def learn_keywords(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet").withColumn("category", F.lit("Hardware"))
    known = part.where("p_partkey % 3 = 0").select("category", F.col("p_name").alias("keyword"))
    return keywords.learn_keywords(known, part.select("category", F.upper("p_name").alias("keyword")))


# Transfers


PAIRS = f"""{LE}, pairs as (select a.txn_id as id1, b.txn_id as id2, a.amount, abs(a.txn_date - b.txn_date) as days_apart, a.statement as account1, b.statement as account2
  from le a join le b on a.amount = b.amount and a.amount > 0 and a.statement <> b.statement and a.txn_id < b.txn_id and abs(a.txn_date - b.txn_date) <= 2)"""


@query(f"with {PAIRS} select id1, id2, cast(amount as double) as amount, days_apart, account1, account2 from pairs")
def cross_account_transfers(spark, sf):
    pairs = transfers.transfer_pairs(adapters.events(spark, sf))
    return pairs.select("id1", "id2", F.col("amount").cast("double").alias("amount"), "days_apart", "account1", "account2")


@query(f"""with {PAIRS}, ranked as (select id1, id2, row_number() over (partition by id1 order by id2) as r1, row_number() over (partition by id2 order by id1) as r2 from pairs),
  gone as (select id1 as id from ranked where r1 = 1 and r2 = 1 union select id2 from ranked where r1 = 1 and r2 = 1)
  select statement, count(*) as n, cast(sum(amount) as double) as amount from le where txn_id not in (select id from gone) group by statement""")
def transfers_removed(spark, sf):
    rows = adapters.events(spark, sf)
    kept = transfers.without_pairs(rows, transfers.mutual_transfers(rows))
    return kept.groupBy("statement").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("amount"))


GREEDY = f"""{PAIRS}, tried as (select *, row_number() over (partition by amount order by id1, id2) as nth from pairs),
  walk as (select distinct amount, cast(0 as bigint) as nth, cast([] as bigint[]) as used from tried union all
    select w.amount, t.nth, case when list_contains(used, id1) or list_contains(used, id2) then used else list_concat(used, [id1, id2]) end from walk w join tried t on t.amount = w.amount and t.nth = w.nth + 1),
  gone as (select unnest(used) as id from walk qualify nth = max(nth) over (partition by amount))"""


@query(f"with recursive {GREEDY} select txn_id, statement from le where txn_id not in (select id from gone)")
def transfers_removed_greedy(spark, sf):
    rows = adapters.events(spark, sf)
    return transfers.without_pairs(rows, transfers.greedy_transfers(rows)).select("txn_id", "statement")


PRINTED = """(case o_orderstatus when 'F' then 'Online Transfer To Savings ' when 'O' then 'Venmo payment ' else 'Interest Payment ' end) || o_orderpriority"""


def printed(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_totalprice", F.expr(PRINTED).alias("place"))


@query(f"select o_orderkey, o_orderstatus = 'F' as is_transfer, o_orderstatus = 'P' as is_noise, o_orderstatus = 'O' as is_payment_app from orders")
def transfer_noise_and_app_routing(spark, sf):
    rows = printed(spark, sf)
    return rows.select("o_orderkey", transfers.is_transfer(F.col("place")).alias("is_transfer"), classify.is_noise(F.col("place")).alias("is_noise"), classify.is_payment_app(F.col("place")).alias("is_payment_app"))


# Reconciliation


TWO = f"""{LO}, a as (select *, row_number() over (partition by txn_date, amount order by txn_id) as rn from lo where txn_id % 3 <> 0),
  b as (select *, row_number() over (partition by txn_date, amount order by txn_id) as rn from lo where txn_id % 4 <> 0),
  r as (select coalesce(a.txn_date, b.txn_date) as txn_date, coalesce(a.amount, b.amount) as amount, coalesce(a.place, b.place) as place,
    case when a.txn_id is not null and b.txn_id is not null then 'A+B' when a.txn_id is not null then 'A only' else 'B only' end as extraction_method
    from a full join b on a.txn_date = b.txn_date and a.amount = b.amount and a.rn = b.rn)"""


def _two(spark, sf):
    rows = adapters.orders(spark, sf).withColumns({"doc_id": F.lit(1), "place_original": F.col("place"), "ordinal": F.col("txn_id")})
    return rows.where("txn_id % 3 <> 0"), rows.where("txn_id % 4 <> 0")


@query(f"with {TWO} select cast(txn_date as varchar) as txn_date, cast(amount as double) as amount, place, extraction_method from r")
def reconcile_two_sources(spark, sf):
    out = reconcile.reconcile(*_two(spark, sf))
    return out.select(F.col("txn_date").cast("string").alias("txn_date"), F.col("amount").cast("double").alias("amount"), "place", "extraction_method")


@query(f"with {TWO} select extraction_method, count(*) as n from r group by 1")
def reconcile_counts(spark, sf):
    return reconcile.reconcile_counts(reconcile.reconcile(*_two(spark, sf)))


@query(f"""with recursive {TWO}, pairs as (select a.txn_date, a.txn_id as ai, b.txn_id as bi, row_number() over (partition by a.txn_date order by a.txn_id, b.txn_id) as nth
    from a join b on a.txn_date = b.txn_date and abs(a.amount - b.amount) <= 0.01),
  walk as (select distinct txn_date, cast(0 as bigint) as nth, cast([] as bigint[]) as in_a, cast([] as bigint[]) as in_b from pairs union all
    select w.txn_date, p.nth, case when f then list_append(in_a, ai) else in_a end, case when f then list_append(in_b, bi) else in_b end
    from walk w join (select * from pairs) p on p.txn_date = w.txn_date and p.nth = w.nth + 1, lateral (select not list_contains(in_a, ai) and not list_contains(in_b, bi) as f)),
  ended as (select * from walk qualify nth = max(nth) over (partition by txn_date)), am as (select unnest(in_a) as id from ended), bm as (select unnest(in_b) as id from ended)
  select cast(txn_date as varchar) as txn_date, cast(amount as double) as amount, place, case when txn_id in (select id from am) then 'A+B' else 'A only' end as extraction_method from a
  union all select cast(txn_date as varchar), cast(amount as double), place, 'B only' from b where txn_id not in (select id from bm)""")
def reconcile_within_cents(spark, sf):
    a, b = _two(spark, sf)
    return reconcile.reconcile_tolerant(a, b).select(F.col("txn_date").cast("string").alias("txn_date"), F.col("amount").cast("double").alias("amount"), "place", "extraction_method")


@query("""with r as (select o_orderstatus as doc_id, count(*) as n, avg(case when o_totalprice > 0 then 1 else 0 end) as amounts, count(distinct o_orderpriority) / count(*) as different from orders group by 1)
  select doc_id, n as transaction_count, greatest(0, 100 - case when amounts < 0.9 then 30 else 0 end - case when n < 3 then 20 else 0 end - case when different < 0.5 then 10 else 0 end) as score,
  100 - case when amounts < 0.9 then 30 else 0 end - case when n < 3 then 20 else 0 end - case when different < 0.5 then 10 else 0 end >= 50 as valid from r""")
def extraction_quality(spark, sf):
    none = F.lit(None).cast("decimal(12,2)")
    rows = adapters.orders(spark, sf).select(
        F.col("statement").alias("doc_id"), F.date_format("txn_date", "MM/dd/yyyy").alias("txn_date_raw"), "place", "amount", none.alias("debits"), none.alias("credits")
    )
    return reconcile.quality_score(rows, "doc_id").drop("issues")


@query("select 'S' || (c_custkey % 7) as doc_id, max_by(case when c_custkey % 2 = 0 then 'A' else 'B' end, (c_custkey * 37 % 101) * 2 + case when c_custkey % 2 = 0 then 1 else 0 end) as extractor from customer group by 1")
def source_choice(spark, sf):
    rows = spark.read.parquet(f"{sf}/customer.parquet").select(
        F.concat(F.lit("S"), F.col("c_custkey") % 7).alias("doc_id"), F.when(F.col("c_custkey") % 2 == 0, "A").otherwise("B").alias("extractor"), (F.col("c_custkey") * 37 % 101).alias("score")
    )
    return reconcile.choose_source(rows)


# Statements


@query("select o_custkey as doc_id, strftime(o_orderdate, '%m/%d/%Y') as txn_date_raw, cast(cast(o_totalprice as decimal(12,2)) as double) as amount, 'ORDER ' || regexp_replace(o_orderpriority, '[^A-Z]', '', 'g') || ' SHOP' as place_original from orders")
def parse_statement_roundtrip(spark, sf):
    rows = statements.parse_statements(adapters.statement_lines(spark, sf), 2001)
    return rows.select("doc_id", "txn_date_raw", F.col("amount").cast("double").alias("amount"), "place_original")


VALUE = "cast(o_totalprice as decimal(12,2))"
RAW = "case when o_orderkey % 4 = 3 then '02/31/2001' else strftime(o_orderdate, '%m/%d/%Y') end"


def printed_accounts(spark, sf):
    """Orders printed as bank statements, read by two extractors: some rows have debit, credit and balance, some dates
    don't exist, every fifth order is there twice, and extractor B misses every third."""
    t = spark.read.parquet(f"{sf}/orders.parquet")
    money = F.concat(F.lit("$"), F.format_string("%.2f", F.expr(VALUE).cast("double")))
    key = F.col("o_orderkey") % 4
    date = F.when(key == 3, "02/31/2001").otherwise(F.date_format("o_orderdate", "MM/dd/yyyy"))
    amounts = F.when(key == 0, F.concat(money, F.lit(" $9.00"))).when(key == 1, F.concat(F.lit("$0.00 "), money, F.lit(" $9.00"))).otherwise(money)
    line = F.concat(date, F.lit(" ORDER "), F.regexp_replace("o_orderpriority", "[^A-Z]", ""), F.lit(" SHOP "), amounts)
    twice = F.explode(F.sequence(F.lit(0), F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0)))
    lines = t.select("o_orderkey", F.col("o_custkey").cast("string").alias("doc_id"), line.alias("line"), twice.alias("copy"))
    each = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "copy", "line"))).alias("x"))
    sides = F.array(*[F.struct(F.lit(side).alias("extractor"), x.alias("x")) for side, x in (("A", F.col("x")), ("B", F.filter("x", lambda r: r["o_orderkey"] % 3 != 0)))])
    body = F.array_join(F.transform("x", lambda r: r["line"]), "\n")
    text = F.concat(F.lit("STEARNSBANK.COM\nCHECKING ACCOUNT\nACCOUNT ACTIVITY\n"), body, F.lit("\nTOTAL DEBITS $0.00"))
    return each.select("doc_id", F.inline(sides)).where(F.size("x") > 0).select("doc_id", "extractor", text.alias("text"), F.lit("2001-01").alias("month"))


@query(f"""with lines as (select cast(o_custkey as varchar) as doc_id, {RAW} as txn_date_raw, {VALUE} as value, case when o_orderkey % 4 = 1 then 'Income' else 'Expense' end as type, o_orderkey
    from orders, range(2) where range = 0 or o_orderkey % 5 = 0),
  counts as (select doc_id, txn_date_raw, value, type, count(*) as a, count(*) filter (o_orderkey % 3 <> 0) as b from lines group by all)
  select doc_id, txn_date_raw, cast(value as double) as amount, type, 'A+B' as extraction_method, b as n, b as n_ids from counts where b > 0 union all
  select doc_id, txn_date_raw, cast(value as double), type, 'A only', a - b, a - b from counts where a > b""")
def monthly_ledger(spark, sf):
    rows = monthly.parse_month(printed_accounts(spark, sf), monthly.Settings(2001))
    return rows.groupBy("doc_id", "txn_date_raw", F.col("amount").cast("double").alias("amount"), "type", "extraction_method").agg(F.count("*").alias("n"), F.count_distinct("txn_id").alias("n_ids"))


CLOSED = """case when txn_id % 11 = 0 then 'Venmo ' else '' end || place"""
MONTH = {"Clicks": ["click"], "Views": ["view"], "Buying": ["purchase", "cart"]}


@query(f"""with recursive {GREEDY}, kept as (select txn_id, amount, {CLOSED} as place, case when txn_id % 7 = 0 then 'Income' else 'Expense' end as type from le where txn_id not in (select id from gone)),
  c as (select *, {"case " + " ".join(f"when regexp_matches(lower(place), '{'|'.join(ks)}') then '{k}'" for k, ks in MONTH.items()) + " else 'Uncategorized' end"} as category from kept where txn_id % 97 <> 0)
  select case when type = 'Income' then 'income' when contains(place, 'Venmo') or category = 'Uncategorized' then 'review' else 'expenses' end as ledger, txn_id, category, cast(amount as double) as amount from c
  union all select 'income', txn_id, 'Views', cast(amount as double) from le where txn_id % 97 = 0""")
def month_closed(spark, sf):
    """Events as a month's ledger of several accounts: transfers between them go, the rest is categorised, split and put
    up for review; every 97th row has been decided on before, with a category that is misspelt."""
    rows = adapters.events(spark, sf).withColumns({"place": F.expr(CLOSED), "account_id": F.col("statement"), "type": F.when(F.col("txn_id") % 7 == 0, "Income").otherwise("Expense")})
    decided = rows.where("txn_id % 97 = 0").withColumns({"classification": F.lit(" income"), "category": F.lit("veiws"), "uncategorized": F.lit(True)})
    out = monthly.build_month(rows, monthly.Settings(2001, categories=MONTH), reviewed=decided)
    parts = [x.select(F.lit(name).alias("ledger"), "txn_id", "category", F.col("amount").cast("double").alias("amount")) for name, x in out.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


ABOUT = """case c_nationkey % 5 when 0 then 'Welcome to STEARNSBANK.COM' when 1 then 'Issued by First National Bank' when 2 then 'see www.magnifi.org' when 3 then 'Scheels Visa card' else 'hello' end
  || chr(10) || case c_nationkey % 3 when 0 then 'CHECKING ACCOUNT' when 1 then 'MasterCard statement' else 'nothing' end"""


@query("""select c_custkey, case c_nationkey % 5 when 0 then 'Stearns Bank' when 1 then 'First National Bank of Omaha' when 2 then 'Magnifi Financial' when 3 then 'Scheels Visa' else 'Unknown' end as bank,
  c_nationkey % 3 <> 0 and (c_nationkey % 3 = 1 or c_nationkey % 5 = 3) as is_card from customer""")
def bank_and_account_type(spark, sf):
    rows = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", F.expr(ABOUT.replace("chr(10)", "char(10)")).alias("text"))
    return rows.select("c_custkey", statements.bank_name(F.col("text")).alias("bank"), statements.is_credit_card(F.col("text")).alias("is_card"))


@query("select o_orderkey, cast(cast(o_totalprice as decimal(12,2)) as double) as first_amount, cast(1234.50 as double) as second_amount, 'SHOP ' || o_orderstatus as description from orders")
def parse_amounts(spark, sf):
    t = spark.read.parquet(f"{sf}/orders.parquet")
    text = F.concat(F.lit("SHOP  $"), F.format_number(F.col("o_totalprice").cast("decimal(12,2)"), 2), F.lit(" "), F.col("o_orderstatus"), F.lit(" 1,234.50"))
    found = amounts.extract_amounts(text)
    return t.select("o_orderkey", F.get(found, 0).cast("double").alias("first_amount"), F.get(found, 1).cast("double").alias("second_amount"), amounts.strip_amounts(text).alias("description"))


@query("select o_orderkey, case o_orderkey % 3 when 0 then strftime(o_orderdate, '%m/%d/%Y') when 1 then strftime(o_orderdate, '%m/%d/') || '20' || strftime(o_orderdate, '%y') else strftime(o_orderdate, '%m/%d/') || '1999' end as leading from orders")
def parse_leading_dates(spark, sf):
    t = spark.read.parquet(f"{sf}/orders.parquet")
    form = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "MM/dd/yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "MM/dd/yy")).otherwise(F.date_format("o_orderdate", "MM-dd"))
    return t.select("o_orderkey", dates.leading_date(F.concat(form, F.lit(" SHOP 1.00")), F.lit(1999)).alias("leading"))


@query("select o_orderkey, 'statement_' || strftime(o_orderdate, '%Y-%m-%d') || '.pdf' as path, strftime(o_orderdate, '%Y-%m') as month from orders")
def filename_month(spark, sf):
    t = spark.read.parquet(f"{sf}/orders.parquet")
    path = F.concat(F.lit("statement_"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(".pdf"))
    return t.select("o_orderkey", path.alias("path"), dates.file_month(path).alias("month"))


@query("""select o_orderkey, cast(case o_orderkey % 4 when 3 then null else cast(o_orderdate as date) end as varchar) as txn_date,
  case when o_orderkey % 4 = 3 then false else strftime(o_orderdate, '%Y-%m') = '1998-03' end as in_month from orders""")
def manual_month_validation(spark, sf):
    t = spark.read.parquet(f"{sf}/orders.parquet")
    k = F.col("o_orderkey") % 4
    typed = F.when(k == 0, F.date_format("o_orderdate", "M/d/yyyy")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 2, F.date_format("o_orderdate", "MM-dd-yyyy")).otherwise("soon")
    date = dates.parse_manual_date(typed, 1998)
    return t.select("o_orderkey", date.cast("string").alias("txn_date"), classify.in_month(date, F.lit("1998-03")).alias("in_month"))


@query("""select o_orderkey, case when o_orderstatus = 'P' then 'PAGE ' || o_orderkey when o_orderkey % 5 = 0 then 'ab' when o_orderkey % 5 = 1 then '12 34' else 'Corner shop' end as place,
  o_orderstatus = 'P' or o_orderkey % 5 < 2 as garbage from orders""")
def garbage_filter(spark, sf):
    place = F.expr("case when o_orderstatus = 'P' then 'PAGE ' || o_orderkey when o_orderkey % 5 = 0 then 'ab' when o_orderkey % 5 = 1 then '12 34' else 'Corner shop' end")
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", place.alias("place"), statements.is_garbage(place).alias("garbage"))


@query("""select o_orderkey, case when o_orderkey % 2 = 0 then 'Expense' when o_orderstatus = 'F' then 'Income' when o_orderstatus = 'O' then 'Expense' else 'Income' end as type from orders""")
def classify_income_expense(spark, sf):
    t = spark.read.parquet(f"{sf}/orders.parquet")
    none, amount = F.lit(None).cast("decimal(12,2)"), F.col("o_totalprice").cast("decimal(12,2)")
    credit = F.when(F.col("o_orderstatus") == "F", amount)
    text = F.when(F.col("o_orderstatus") == "P", "Acme Payroll").otherwise("Corner shop")
    kind = classify.transaction_type(F.col("o_orderkey") % 2 != 0, F.when(credit.isNull(), amount), none, credit, text)
    return t.select("o_orderkey", kind.alias("type"))


# Names


@query(r"select distinct p_name as raw, regexp_replace(p_name || 'Shop', '([a-z])([A-Z])', '\1 \2', 'g') as split from part")
def camel_split(spark, sf):
    t = spark.read.parquet(f"{sf}/part.parquet")
    return t.select(F.col("p_name").alias("raw"), names.camel_split(F.concat("p_name", F.lit("Shop"))).alias("split")).distinct()


# Merchants


@query(f"with {LL} select place, count(*) as freq, case when count(*) >= 5 then 'high' when count(*) >= 2 then 'medium' else 'low' end as tier from ll where length(place) >= 3 group by place")
def merchant_frequency_tiers(spark, sf):
    return merchants.merchant_frequency(adapters.line_items(spark, sf))


@query("select o_orderkey, case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'Cached ' || o_orderpriority else 'Shop ' || o_orderstatus end as place from orders")
def merchant_cache_lookup(spark, sf):
    t = spark.read.parquet(f"{sf}/orders.parquet")
    rows = t.select("o_orderkey", F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.lower("o_orderpriority")).otherwise(F.concat(F.lit("raw "), F.col("o_orderstatus"))).alias("place_original"), "o_orderstatus")
    cache = t.select("o_orderpriority").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).distinct().select(merchants.cache_key(F.col("o_orderpriority")).alias("cache_key"), F.concat(F.lit("Cached "), F.col("o_orderpriority")).alias("place"))
    extra = t.select("o_orderstatus").distinct().select(merchants.cache_key(F.concat(F.lit("raw "), F.col("o_orderstatus"))).alias("cache_key"), F.concat(F.lit("Shop "), F.col("o_orderstatus")).alias("place"))
    return merchants.clean_names(rows, cache.unionByName(extra)).select("o_orderkey", "place")


@query(f"""with {LL}, known as (select place, count(*) as freq from ll where length(place) >= 3 group by place), n as (select distinct split_part(p_name, ' ', 2) as name from part),
  hit as (select name, place, freq from n, known where length(replace(name, ' ', '')) >= 3 and (contains(replace(lower(place), ' ', ''), lower(name)) or contains(lower(name), replace(lower(place), ' ', ''))))
  select name, place, freq, row_number() over (partition by name order by freq desc, place) as rank from hit qualify rank <= 5""")
def similar_merchants_topk(spark, sf):
    known = merchants.merchant_frequency(adapters.line_items(spark, sf))
    part = spark.read.parquet(f"{sf}/part.parquet").select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("name")).distinct()
    return merchants.similar_merchants(part, known).withColumn("rank", F.col("rank").cast("long"))


@query("""with h as (select p_partkey as ordinal, case when p_partkey % 2 = 0 then upper(p_name) else p_name end as place from part), f as (select place, min(ordinal) as seen from h group by place)
  select upper(trim(place)) as cache_key, max_by(place, seen) as place from f group by 1""")
def learned_merchants(spark, sf):
    t = spark.read.parquet(f"{sf}/part.parquet")
    history = t.select(F.col("p_partkey").alias("ordinal"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("place"))
    return merchants.learn_names(history)


# Scores and votes


@query("""with c as (select distinct p_name as result, upper(p_name) as original, p_size % 3 as prompt from part)
  select result, prompt, least(100, greatest(0, 50 + case when length(result) between 3 and 30 then 20 when length(result) > 30 then -10 else 0 end
    + case when regexp_matches(result[1], '[A-Z]') then 10 else 0 end + 0 + case when contains(result, ' ') then 10 else 0 end
    + case when regexp_matches(upper(result), 'PURCHASE|RECUR|POS|ACH|WEB|PMTS') then -20 else 15 end + case when prompt = 2 then 10 else 0 end)) as confidence from c""")
def candidate_confidence(spark, sf):
    rows = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_name").alias("result"), F.upper("p_name").alias("original"), (F.col("p_size") % 3).alias("prompt")).distinct()
    return rows.select("result", "prompt", scoring.candidate_confidence(F.col("result"), F.col("original"), F.col("prompt")).alias("confidence"))


@query("""with c as (select p_brand as brand, p_partkey as prompt, p_name as result, p_size as confidence from part),
  s as (select *, confidence + case when regexp_matches(lower(result), 'fargo|west|east|north|south|saint|st |albany|moorhead|alexandria|savage|oakland| nd| mn| ca| wa| va| me| sd| ny') then -50 else 0 end
    + case when regexp_matches(upper(result), 'PURCHASE|RECUR|POS|WL\\*') then -30 else 0 end + case when length(result) between 5 and 25 then 15 when length(result) > 35 then -10 else 0 end
    + case when len(string_split(result, ' ')) between 2 and 3 then 10 when len(string_split(result, ' ')) > 5 then -10 else 0 end as score from c)
  select brand, case when count(distinct lower(result)) = 1 then min_by(result, prompt) else first(result order by score desc, prompt) end as winner, count(distinct lower(result)) = 1 as unanimous from s group by brand""".replace("\\\\", "\\"))
def weighted_vote(spark, sf):
    rows = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("prompt"), F.col("p_name").alias("result"), F.col("p_size").alias("confidence"))
    return scoring.weighted_vote(rows, ["brand"])


@query("""with d as (select distinct case when p_partkey % 3 = 0 then 'POS ' || upper(p_name) when p_partkey % 3 = 1 then upper(p_name) else p_name || ' one two three four' end as place from part)
  select place, 100 + case when contains(upper(place), 'POS ') then -30 else 0 end + case when length(place) > 40 then -20 when length(place) > 25 then -10 else 0 end
    + case when len(string_split(place, ' ')) > 5 then -15 when len(string_split(place, ' ')) > 4 then -5 else 0 end + case when regexp_matches(place[1], '[A-Z]') then 5 else 0 end
    + case when regexp_matches(place[1], '[a-z0-9]') then -10 else 0 end as score from d""")
def description_scoring(spark, sf):
    place = F.expr("case when p_partkey % 3 = 0 then 'POS ' || upper(p_name) when p_partkey % 3 = 1 then upper(p_name) else p_name || ' one two three four' end")
    rows = spark.read.parquet(f"{sf}/part.parquet").select(place.alias("place")).distinct()
    return rows.select("place", scoring.description_score(F.col("place")).alias("score"))


# Review


REVIEW = """select o_orderkey as txn_id, case o_orderkey % 5 when 0 then 'Income' when 1 then 'EXPENSE' when 2 then ' ' when 3 then null else 'later' end as classification, o_orderpriority as place from orders"""


@query(f"with r as ({REVIEW}) select case when upper(trim(coalesce(classification, ''))) = '' then 'open' when upper(classification) = 'INCOME' then 'income' when upper(classification) = 'EXPENSE' then 'expense' else 'other' end as state, count(*) as n from r group by 1")
def review_split(spark, sf):
    t = spark.read.parquet(f"{sf}/orders.parquet")
    state = review.review_state(F.expr("case o_orderkey % 5 when 0 then 'Income' when 1 then 'EXPENSE' when 2 then ' ' when 3 then null else 'later' end"))
    return t.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query(f"with r as ({REVIEW}) select 'expenses' as ledger, txn_id from r where classification = 'EXPENSE' union all select 'income', txn_id from r where classification = 'Income' union all select 'review', txn_id from r where coalesce(classification, '') not in ('EXPENSE', 'Income')")
def review_merge(spark, sf):
    t = spark.read.parquet(f"{sf}/orders.parquet").select(
        F.col("o_orderkey").alias("txn_id"), F.expr("case o_orderkey % 5 when 0 then 'Income' when 1 then 'EXPENSE' when 2 then ' ' when 3 then null else 'later' end").alias("classification"), F.col("o_orderpriority").alias("place")
    )
    none = t.drop("classification").limit(0)
    merged = review.apply_review(none, none, t)
    parts = [rows.select(F.lit(name).alias("ledger"), "txn_id") for name, rows in merged.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"with {LO}, {LE} select statement, count(*) as n, cast(sum(amount) as double) as amount, count(month) as with_month from (select statement, amount, month from lo union all by name select statement, amount from le) group by statement")
def union_statements(spark, sf):
    both = adapters.orders(spark, sf).select("statement", "amount", "month").unionByName(adapters.events(spark, sf).select("statement", "amount"), allowMissingColumns=True)
    return both.groupBy("statement").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("amount"), F.count("month").alias("with_month"))


@query("select c_custkey, c_mktsegment as text, c_nationkey as x from customer where c_custkey % 3 <> 0")
def ocr_word_boxes(spark, sf):
    t = spark.read.parquet(f"{sf}/customer.parquet")
    box = "named_struct('text', {}, 'x', c_nationkey, 'y', 0, 'width', 10, 'height', 10, 'confidence', 0.9D)"
    boxes = F.expr(f"array({box.format('if(c_custkey % 3 = 0, repeat(chr(32), 2), c_mktsegment)')}, {box.format(chr(39) + ' ' + chr(39))})")
    return t.select("c_custkey", F.explode(providers.clean_boxes(boxes)).alias("w")).select("c_custkey", "w.text", "w.x")


@query("""with words as (select l_orderkey, l_linenumber, 5 as x, 2 * (20 * l_linenumber + l_partkey % 3) + 12 as middle, 'Q' || cast(l_quantity as int) as text from lineitem
    union all select l_orderkey, l_linenumber, 50 + l_suppkey % 40, 2 * (20 * l_linenumber + l_suppkey % 3) + 12, l_returnflag from lineitem where l_suppkey % 40 <= 18),
  lines as (select l_orderkey, l_linenumber, string_agg(text, ' ' order by x, middle, text) as line from words group by all)
  select l_orderkey, string_agg(line, chr(10) order by l_linenumber) as cell from lines group by l_orderkey""")
def page_cells(spark, sf):
    """Each order as a page of recognised words in no order, some of them cut by the right edge of a cell; the cell's text."""
    t = spark.read.parquet(f"{sf}/lineitem.parquet")

    def word(text: Column, x: Column, key: str) -> Column:
        y = 20 * F.col("l_linenumber") + F.col(key) % 3
        parts = {"text": text, "x": x.cast("int"), "y": y.cast("int"), "width": F.lit(20), "height": F.lit(12), "confidence": F.lit(0.9)}
        return F.struct(*[c.alias(name) for name, c in parts.items()])

    both = F.array(word(F.col("l_returnflag"), 50 + F.col("l_suppkey") % 40, "l_suppkey"), word(F.concat(F.lit("Q"), F.col("l_quantity").cast("int")), F.lit(5), "l_partkey"))
    pages = t.select("l_orderkey", both.alias("boxes")).groupBy("l_orderkey").agg(F.flatten(F.collect_list("boxes")).alias("boxes"))
    edges = [F.lit(n) for n in (-5, -5, 80, 2000, 1000, 1000)]
    return pages.select("l_orderkey", providers.cell_text(F.col("boxes"), *edges).alias("cell"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES | texts.QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLE | texts.ORACLE
