"""Accounting: orders are bills, some are paid later, some cause expenses."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.catalog import query
from strandline.catalog.series import CYCLES, TENANCIES, cycles, tenancies
from strandline.functions import money
from strandline.operators import joins, ledger
from strandline.plans.scratch import table

_C = "CAST(round(o_totalprice * 100) AS BIGINT)"
_PAID = f"CASE WHEN o_orderkey % 5 = 0 THEN {_C} // 2 ELSE {_C} END"
JOURNAL = f"""(
SELECT o_orderkey AS txn_id, o_orderdate AS txn_date, 0 AS leg_seq, 1100 AS account_code, o_custkey AS customer_id, {_C} AS debit_cents, CAST(0 AS BIGINT) AS credit_cents FROM orders
UNION ALL SELECT o_orderkey, o_orderdate, 1, 4000, NULL, 0, {_C} FROM orders
UNION ALL SELECT o_orderkey + 10000000, o_orderdate + INTERVAL 25 DAY, 0, 1000, NULL, {_PAID}, 0 FROM orders WHERE o_orderkey % 3 <> 0
UNION ALL SELECT o_orderkey + 10000000, o_orderdate + INTERVAL 25 DAY, 1, 1100, o_custkey, 0, {_PAID} FROM orders WHERE o_orderkey % 3 <> 0
UNION ALL SELECT o_orderkey + 20000000, o_orderdate, 0, 5100 + CAST(o_custkey % 3 AS INTEGER) * 100, NULL, {_C} // 10, 0 FROM orders WHERE o_orderkey % 4 = 0
UNION ALL SELECT o_orderkey + 20000000, o_orderdate, 1, 1000, NULL, 0, {_C} // 10 FROM orders WHERE o_orderkey % 4 = 0)"""


def journal(spark, sf_dir):
    """All legs in one pass over orders."""
    key, zero = F.col("o_orderkey"), F.lit(0).cast("long")
    c = money.cents(F.col("o_totalprice"))
    paid = F.when(key % 5 == 0, F.floor(c / 2)).otherwise(c)
    spent, later = F.floor(c / 10), F.timestamp_add("DAY", F.lit(25), F.col("o_orderdate"))
    nobody = F.lit(None).cast("long")

    def leg(txn, date, seq, account, customer, debit, credit):
        return F.struct(txn.alias("txn_id"), date.alias("txn_date"), F.lit(seq).alias("leg_seq"), account.cast("int").alias("account_code"), customer.alias("customer_id"), debit.alias("debit_cents"), credit.alias("credit_cents"))

    date, customer = F.col("o_orderdate"), F.col("o_custkey")
    none = F.array().cast("array<struct<txn_id:bigint,txn_date:timestamp_ntz,leg_seq:int,account_code:int,customer_id:bigint,debit_cents:bigint,credit_cents:bigint>>")
    bill = F.array(leg(key, date, 0, F.lit(1100), customer, c, zero), leg(key, date, 1, F.lit(4000), nobody, zero, c))
    pay = F.array(leg(key + 10000000, later, 0, F.lit(1000), nobody, paid, zero), leg(key + 10000000, later, 1, F.lit(1100), customer, zero, paid))
    cost = F.array(leg(key + 20000000, date, 0, 5100 + customer % 3 * 100, nobody, spent, zero), leg(key + 20000000, date, 1, F.lit(1000), nobody, zero, spent))
    legs = F.concat(bill, F.when(key % 3 != 0, pay).otherwise(none), F.when(key % 4 == 0, cost).otherwise(none))
    return table(spark, sf_dir, "orders").select(F.explode(legs).alias("l")).select("l.*")


DAY = "1998-06-30"


@query("ac_chart", "SELECT * FROM (VALUES (1000, 'Cash', 'asset', 'debit'), (1100, 'Receivable', 'asset', 'debit'), (2000, 'Payable', 'liability', 'credit'), (3000, 'Equity', 'equity', 'credit'), (3500, 'Reserves', 'equity', 'credit'), (4000, 'Revenue', 'income', 'credit'), (5100, 'Operations', 'expense', 'debit'), (5900, 'Other', 'expense', 'debit'), (9000, 'Suspense', 'asset', 'debit')) t(code, name, kind, normal_side)")
def _(spark, sf_dir):
    return ledger.chart(spark)


@query("ac_balance", f"SELECT customer_id, CAST(sum(debit_cents - credit_cents) AS BIGINT) AS balance_cents FROM {JOURNAL} WHERE account_code = 1100 AND customer_id IS NOT NULL AND txn_date <= TIMESTAMP '{DAY}' GROUP BY 1")
def _(spark, sf_dir):
    return ledger.balances(journal(spark, sf_dir), F.lit(DAY).cast("timestamp_ntz"))


@query("ac_who_owes", f"WITH b AS (SELECT customer_id, CAST(sum(debit_cents - credit_cents) AS BIGINT) AS balance_cents FROM {JOURNAL} WHERE account_code = 1100 GROUP BY 1 HAVING sum(debit_cents - credit_cents) >= 50000000), t AS (SELECT customer_id, string_agg(CAST(connection_id AS VARCHAR), ', ' ORDER BY CAST(connection_id AS VARCHAR)) AS connections FROM {TENANCIES} WHERE end_date IS NULL GROUP BY 1) SELECT b.customer_id, balance_cents, coalesce(connections, '') AS connections FROM b LEFT JOIN t ON b.customer_id = t.customer_id")
def _(spark, sf_dir):
    owing = ledger.who_owes(journal(spark, sf_dir), 50_000_000)
    names = tenancies(spark, sf_dir).where("end_date is null").groupBy(F.col("customer_id").alias("t")).agg(F.array_join(F.sort_array(F.collect_list(F.col("connection_id").cast("string"))), ", ").alias("connections"))
    return owing.join(names, F.col("customer_id") == F.col("t"), "left").select("customer_id", "balance_cents", F.coalesce("connections", F.lit("")).alias("connections"))


_OPEN = f"""l AS (SELECT *, sum(debit_cents - credit_cents) OVER w AS net, sum(debit_cents) OVER w AS billed FROM {JOURNAL} WHERE account_code = 1100 AND customer_id IS NOT NULL AND txn_date <= TIMESTAMP '{DAY}'
 WINDOW w AS (PARTITION BY customer_id ORDER BY txn_date, txn_id, leg_seq ROWS UNBOUNDED PRECEDING)),
u AS (SELECT customer_id, max(billed) - arg_max(net, struct_pack(a := txn_date, b := txn_id, c := leg_seq)) - greatest(-min(net), 0) AS used FROM l GROUP BY 1),
o AS (SELECT l.customer_id, txn_date AS bill_date, CAST(least(debit_cents, greatest(billed - used, 0)) AS BIGINT) AS open_cents FROM l JOIN u ON l.customer_id = u.customer_id WHERE debit_cents > 0)"""


@query("ac_fifo_oldest", f"WITH {_OPEN} SELECT customer_id, min(bill_date) AS oldest_bill FROM o WHERE open_cents > 0 GROUP BY 1")
def _(spark, sf_dir):
    return ledger.oldest_open(journal(spark, sf_dir), F.lit(DAY).cast("timestamp_ntz"))


_AGE = f"date_diff('day', CAST(bill_date AS DATE), DATE '{DAY}')"


@query("ac_aging", f"WITH {_OPEN} SELECT customer_id, CAST(sum(CASE WHEN {_AGE} <= 30 THEN open_cents ELSE 0 END) AS BIGINT) AS d0_30, CAST(sum(CASE WHEN {_AGE} BETWEEN 31 AND 60 THEN open_cents ELSE 0 END) AS BIGINT) AS d31_60, CAST(sum(CASE WHEN {_AGE} BETWEEN 61 AND 90 THEN open_cents ELSE 0 END) AS BIGINT) AS d61_90, CAST(sum(CASE WHEN {_AGE} > 90 THEN open_cents ELSE 0 END) AS BIGINT) AS d90_up, CAST(sum(open_cents) AS BIGINT) AS total_cents FROM o GROUP BY 1 HAVING sum(open_cents) <> 0")
def _(spark, sf_dir):
    return ledger.aging(journal(spark, sf_dir), F.lit(DAY).cast("timestamp_ntz"))


@query("ac_trial_balance", f"SELECT account_code, CAST(sum(debit_cents) AS BIGINT) AS debit_cents, CAST(sum(credit_cents) AS BIGINT) AS credit_cents, CAST(sum(debit_cents - credit_cents) AS BIGINT) AS net_cents FROM {JOURNAL} GROUP BY ROLLUP (account_code)")
def _(spark, sf_dir):
    return ledger.trial_balance(journal(spark, sf_dir), total=True)


@query("ac_pnl", f"SELECT CAST(year(txn_date) AS INTEGER) AS year, CAST(sum(CASE WHEN account_code = 4000 THEN credit_cents - debit_cents ELSE 0 END) AS BIGINT) AS revenue_cents, CAST(sum(CASE WHEN account_code BETWEEN 5000 AND 5999 THEN debit_cents - credit_cents ELSE 0 END) AS BIGINT) AS expense_cents, CAST(sum(CASE WHEN account_code = 4000 THEN credit_cents - debit_cents WHEN account_code BETWEEN 5000 AND 5999 THEN credit_cents - debit_cents ELSE 0 END) AS BIGINT) AS net_cents FROM {JOURNAL} WHERE txn_date >= TIMESTAMP '1996-01-01' AND txn_date <= TIMESTAMP '{DAY}' GROUP BY 1")
def _(spark, sf_dir):
    j = journal(spark, sf_dir).withColumn("year", F.year("txn_date"))
    return ledger.profit_and_loss(j, F.expr("timestamp_ntz'1996-01-01'"), F.lit(DAY).cast("timestamp_ntz"), ["year"])


@query("ac_cycle_totals", f"""WITH e AS (SELECT account_code, debit_cents AS amount, CAST(txn_date AS DATE) AS d FROM {JOURNAL} WHERE account_code BETWEEN 5000 AND 5999), c AS (SELECT *, lead(cycle_id) OVER (ORDER BY cycle_id) AS nx FROM {CYCLES}),
x AS (SELECT e.account_code, amount, cycle_id, nx, CAST(trunc(amount * 0.6) AS BIGINT) AS this FROM e JOIN c ON d BETWEEN period_start AND period_end)
SELECT cycle_id, account_code, CAST(sum(a) AS BIGINT) AS amount_cents FROM (SELECT cycle_id, account_code, this AS a FROM x UNION ALL SELECT nx, account_code, amount - this FROM x) WHERE cycle_id IS NOT NULL GROUP BY 1, 2 HAVING sum(a) <> 0""")
def _(spark, sf_dir):
    e = journal(spark, sf_dir).where("account_code between 5000 and 5999").select("account_code", F.col("debit_cents").alias("amount_cents"), F.col("txn_date").cast("date").alias("day"))
    c = cycles(spark).withColumn("next_cycle_id", F.lead("cycle_id").over(Window.orderBy("cycle_id")))
    return ledger.cycle_totals(joins.valid_on(e, "day", c, "period_start", "period_end", how="inner").withColumn("this_fraction", F.lit(0.6).cast("decimal(4,2)")))


@query("ac_split", f"SELECT o_orderkey, p AS place, CAST({_C} // 7 + CASE WHEN p < {_C} % 7 THEN 1 ELSE 0 END AS BIGINT) AS share FROM orders, (SELECT CAST(i AS INTEGER) AS p FROM range(0, 7) r(i))")
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(6))))
    c = money.cents(F.col("o_totalprice"))
    return o.select("o_orderkey", "place", money.split(c, F.lit(7), F.col("place")).alias("share"))


@query("ac_scale", "SELECT c_custkey, CAST(trunc(CAST(round(c_acctbal * 100) AS BIGINT) * 0.375) AS BIGINT) AS part, CAST(CAST(round(c_acctbal * 100) AS BIGINT) * 3 // 8 + CASE WHEN c_acctbal < 0 AND CAST(round(c_acctbal * 100) AS BIGINT) * 3 % 8 <> 0 AND CAST(round(c_acctbal * 100) AS BIGINT) * 3 // 8 * 8 < CAST(round(c_acctbal * 100) AS BIGINT) * 3 THEN 1 ELSE 0 END AS BIGINT) AS ratio FROM customer")
def _(spark, sf_dir):
    c = money.cents(F.col("c_acctbal"))
    return table(spark, sf_dir, "customer").select("c_custkey", money.scale(c, F.lit(0.375)).alias("part"), money.scale_ratio(c, F.lit(3), F.lit(8)).alias("ratio"))


@query("ac_shuffle")
def _(spark, sf_dir):
    return spark.createDataFrame([(s, money.shuffled(12, s)) for s in (0, 1, 820454400000000000)], "seed long, places array<int>")


@query("ac_allocate")
def _(spark, sf_dir):
    weights = [float(r.s_suppkey % 5 + 1) for r in table(spark, sf_dir, "supplier").select("s_suppkey").orderBy("s_suppkey").collect()]
    shares = ledger.ShareByWeight(margin=0.1).allocate(1_234_567, weights, 820454400000000000)
    return spark.createDataFrame(list(zip(range(len(shares)), weights, shares, strict=True)), "place int, weight double, share_cents long")


@query("ext_policy", "SELECT 'share-by-weight' AS policy, 'ShareByWeight' AS class")
def _(spark, sf_dir):
    return spark.createDataFrame([(n, c.__name__) for n, c in ledger.Policy.registry.items()], "policy string, class string")


@query("ac_verify_balance", f"SELECT txn_id, CAST(sum(debit_cents) AS BIGINT) AS debit_cents, CAST(sum(credit_cents) AS BIGINT) AS credit_cents FROM {JOURNAL} WHERE NOT (txn_id % 1000 = 7 AND leg_seq = 1) GROUP BY 1 HAVING sum(debit_cents) <> sum(credit_cents)")
def _(spark, sf_dir):
    return ledger.unbalanced(journal(spark, sf_dir).where("not (txn_id % 1000 = 7 and leg_seq = 1)"))


@query("ac_verify_customers", f"SELECT DISTINCT customer_id FROM {JOURNAL} WHERE customer_id IS NOT NULL AND customer_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 <> 1)")
def _(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_custkey % 50 <> 1")
    return ledger.dangling(journal(spark, sf_dir), "customer_id", c, "c_custkey").select("customer_id").distinct()


@query("ac_verify_tenancies", f"SELECT connection_id, customer_id FROM {TENANCIES} WHERE customer_id NOT IN (SELECT c_custkey FROM customer)")
def _(spark, sf_dir):
    return ledger.dangling(tenancies(spark, sf_dir), "customer_id", table(spark, sf_dir, "customer"), "c_custkey").select("connection_id", "customer_id")


@query("ac_verify_tenancy_overlap", f"SELECT a.customer_id, a.connection_id AS a_id, b.connection_id AS b_id FROM {TENANCIES} a JOIN {TENANCIES} b ON a.customer_id = b.customer_id AND a.connection_id < b.connection_id AND a.start_date <= coalesce(b.end_date, DATE '9999-01-01') AND b.start_date <= coalesce(a.end_date, DATE '9999-01-01')")
def _(spark, sf_dir):
    return joins.overlapping(tenancies(spark, sf_dir), "customer_id", "connection_id", "start_date", "end_date")


@query("ac_verify_coverage", f"SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM {JOURNAL} j WHERE j.txn_id = o_orderkey AND account_code = 1100 AND debit_cents > 20000000)")
def _(spark, sf_dir):
    j = journal(spark, sf_dir).where("account_code = 1100 and debit_cents > 20000000").select("txn_id")
    return table(spark, sf_dir, "orders").select("o_orderkey").join(j, F.col("o_orderkey") == F.col("txn_id"), "left_anti")


@query("ac_verify_breakdown", f"SELECT o_custkey, CAST(sum({_C}) AS BIGINT) AS bills, CAST(any_value(j.s) AS BIGINT) AS posted FROM orders JOIN (SELECT customer_id, sum(debit_cents) AS s FROM {JOURNAL} WHERE account_code = 1100 AND txn_id % 500 <> 3 GROUP BY 1) j ON o_custkey = customer_id GROUP BY 1 HAVING sum({_C}) <> any_value(j.s)")
def _(spark, sf_dir):
    posted = journal(spark, sf_dir).where("account_code = 1100 and txn_id % 500 <> 3").groupBy("customer_id").agg(F.sum("debit_cents").alias("posted"))
    bills = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(money.cents(F.col("o_totalprice"))).alias("bills"))
    return bills.join(posted, F.col("o_custkey") == F.col("customer_id")).where("bills <> posted").select("o_custkey", "bills", "posted")


@query("ac_verify_merges", "SELECT c_custkey FROM customer WHERE c_custkey % 40 = 0 AND c_custkey % 80 = 0")
def _(spark, sf_dir):
    """Customers merged into one that is itself merged: every 40th goes to half its number."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 40 == 0, F.floor(F.col("c_custkey") / 2)).alias("into"))
    merged = c.where("into is not null")
    return merged.join(merged.select(F.col("c_custkey").alias("m")), F.col("into") == F.col("m"), "left_semi").select("c_custkey")


@query("ac_verify_freshness", f"SELECT account_code, CAST(sum(debit_cents) AS BIGINT) AS now_cents FROM {JOURNAL} WHERE account_code BETWEEN 5000 AND 5999 GROUP BY 1 HAVING sum(debit_cents) <> sum(CASE WHEN txn_date < TIMESTAMP '2001-01-01' THEN debit_cents ELSE 0 END)")
def _(spark, sf_dir):
    """Stored totals that the journal has moved on from."""
    j = journal(spark, sf_dir).where("account_code between 5000 and 5999")
    stored = j.where("txn_date < timestamp_ntz'2001-01-01'").groupBy("account_code").agg(F.sum("debit_cents").alias("then_cents"))
    return j.groupBy("account_code").agg(F.sum("debit_cents").alias("now_cents")).join(stored, "account_code", "left").where("not now_cents <=> then_cents").drop("then_cents")


_POLICIES = "(SELECT 1 AS policy_id, DATE '1995-01-01' AS effective_from, DATE '1997-12-31' AS effective_to UNION ALL SELECT 2, DATE '1998-02-01', NULL)"
_ISSUED = f"""(SELECT *, CASE WHEN cycle_id % 5 = 4 THEN 9 WHEN bill_date < DATE '1998-01-01' THEN 1 ELSE 2 END AS policy_id, cycle_id % 3 <> 0 AS issued,
 CASE WHEN cycle_id % 7 = 6 THEN NULL WHEN cycle_id % 11 = 10 THEN 5 WHEN cycle_id % 3 <> 0 THEN 100 + cycle_id END AS bill_txn_id FROM (SELECT cycle_id, CAST(period_end AS DATE) + 30 AS bill_date FROM {CYCLES}))"""


def _issued(spark):
    """Cycles with the policy each was billed by and the transaction that billed it, some of them wrong."""
    c = cycles(spark).select("cycle_id", F.date_add("period_end", 30).alias("bill_date"))
    n = F.col("cycle_id")
    return c.withColumns({
        "policy_id": F.when(n % 5 == 4, 9).when(F.col("bill_date") < F.lit("1998-01-01").cast("date"), 1).otherwise(2), "issued": n % 3 != 0,
        "bill_txn_id": F.when(n % 7 == 6, None).when(n % 11 == 10, 5).when(n % 3 != 0, 100 + n),
    })


def _policies(spark):
    return spark.createDataFrame([(1, "1995-01-01", "1997-12-31"), (2, "1998-02-01", None)], "policy_id int, effective_from string, effective_to string").select("policy_id", F.col("effective_from").cast("date"), F.col("effective_to").cast("date"))


@query("ac_verify_policy", f"SELECT cycle_id, CASE WHEN p.policy_id IS NULL THEN 'no such policy' WHEN bill_date < effective_from THEN 'not yet effective' ELSE 'expired' END AS fault FROM {_ISSUED} c LEFT JOIN {_POLICIES} p ON c.policy_id = p.policy_id WHERE p.policy_id IS NULL OR (issued AND (bill_date < effective_from OR bill_date > effective_to))")
def _(spark, sf_dir):
    return ledger.policy_faults(_issued(spark), _policies(spark)).select("cycle_id", "fault")


@query("ac_verify_issued", f"SELECT cycle_id, CASE WHEN issued AND bill_txn_id IS NULL THEN 'issued without a transaction' WHEN NOT issued THEN 'a transaction but not issued' ELSE 'no legs' END AS fault FROM {_ISSUED} WHERE (issued AND (bill_txn_id IS NULL OR bill_txn_id NOT IN (SELECT 100 + cycle_id FROM {CYCLES}))) OR (NOT issued AND bill_txn_id IS NOT NULL)")
def _(spark, sf_dir):
    legs = cycles(spark).select((F.col("cycle_id") + 100).alias("txn_id"))
    return ledger.issue_faults(_issued(spark), legs).select("cycle_id", "fault")


_DRIFT_DAY = "1996-06-30"


def _bills(spark, sf_dir, cost=1_000_000):
    connections = tenancies(spark, sf_dir).withColumnsRenamed({"start_date": "first_active", "end_date": "last_active"}).withColumn("weight", (F.col("connection_id") % 4 + 1).cast("double"))
    live = ledger.active(connections, F.lit(_DRIFT_DAY).cast("date"), F.array(F.lit(3).cast("long")))
    return ledger.bill(live, cost, ledger.ShareByWeight(), 836092800000000000)


@query("ac_bill_compute")
def _(spark, sf_dir):
    """A cycle's cost shared among the connections active in it, billed to whoever holds them; refused while stored totals are behind."""
    totals = spark.createDataFrame([(1, 5100, 600_000), (1, 5900, 400_000)], "cycle_id int, account_code int, amount_cents long")
    try:
        ledger.fresh_cost(totals.where("account_code = 5100"), totals, 1)
    except ledger.StaleTotals:
        return _bills(spark, sf_dir, ledger.fresh_cost(totals, totals, 1))
    raise AssertionError("stale totals were taken")


@query("ac_bill_issue", "SELECT * FROM (VALUES (1100, 1000000::BIGINT, 1000000::BIGINT), (4000, 1000000, 1000000)) t(account_code, debit_cents, credit_cents)")
def _(spark, sf_dir):
    """Bills posted, and posted back: every account ends where it was."""
    issued = ledger.issue(_bills(spark, sf_dir), 101, _DRIFT_DAY)
    back = ledger.reverse(issued, 101, 102, "1996-07-31")
    return issued.unionByName(back).groupBy("account_code").agg(F.sum("debit_cents").alias("debit_cents"), F.sum("credit_cents").alias("credit_cents"))


@query("ac_verify_drift", f"SELECT connection_id, CASE WHEN connection_id % 10 = 1 THEN 'other amounts' ELSE 'not recorded' END AS fault FROM {TENANCIES} WHERE start_date <= DATE '{_DRIFT_DAY}' AND (end_date IS NULL OR DATE '{_DRIFT_DAY}' < end_date) AND connection_id <> 3 AND connection_id % 10 < 2")
def _(spark, sf_dir):
    """Recorded bills against those that the policy makes now: some were changed by a cent, some are missing."""
    now = _bills(spark, sf_dir)
    recorded = now.where("connection_id % 10 <> 0").withColumn("bill_cents", F.col("bill_cents") + F.when(F.col("connection_id") % 10 == 1, 1).otherwise(0))
    return ledger.drift(recorded, now).select("connection_id", "fault")


@query("ac_customer_merge", f"WITH b AS (SELECT coalesce(sum(debit_cents - credit_cents), 0)::BIGINT AS c FROM {JOURNAL} WHERE account_code = 1100 AND customer_id = 7) SELECT 99::BIGINT AS txn_id, TIMESTAMP '2001-09-01' AS txn_date, leg_seq, 1100 AS account_code, customer_id, CASE WHEN (c >= 0) = (leg_seq = 1) THEN abs(c) ELSE 0 END AS debit_cents, CASE WHEN (c >= 0) = (leg_seq = 0) THEN abs(c) ELSE 0 END AS credit_cents, 'merge' AS source FROM b, (VALUES (0, 7), (1, 8)) t(leg_seq, customer_id)")
def _(spark, sf_dir):
    balance = ledger.balances(journal(spark, sf_dir).where("customer_id = 7")).first()
    return ledger.transfer(spark, 99, "2001-09-01", balance.balance_cents if balance else 0, 7, 8)


@query("ac_journal_write", "SELECT 1::BIGINT AS txn_id, TIMESTAMP '2001-09-01' AS txn_date, leg_seq, account_code, customer_id, debit_cents, credit_cents, 'manual' AS source FROM (VALUES (0, 1100, 1, 500::BIGINT, 0::BIGINT), (1, 4000, NULL, 0, 500)) t(leg_seq, account_code, customer_id, debit_cents, credit_cents)")
def _(spark, sf_dir):
    return ledger.post(spark, 1, "2001-09-01", [{"account_code": 1100, "customer_id": 1, "debit_cents": 500}, {"account_code": 4000, "credit_cents": 500}])


@query("ac_journal_show", f"SELECT txn_id, leg_seq, account_code, debit_cents, credit_cents FROM {JOURNAL} WHERE customer_id = 10 OR (account_code = 5100 AND txn_date < TIMESTAMP '1995-02-01')")
def _(spark, sf_dir):
    return journal(spark, sf_dir).where("customer_id = 10 or (account_code = 5100 and txn_date < timestamp_ntz'1995-02-01')").select("txn_id", "leg_seq", "account_code", "debit_cents", "credit_cents")


@query("ac_fuzzy_lookup", "SELECT wanted, replace(found, '#', chr(39)) AS found FROM (VALUES ('7', '#7# was not found'), ('asia', 'ASIA'), ('AMER', 'AMERICA'), ('a', '#a# is ambiguous')) t(wanted, found)")
def _(spark, sf_dir):
    rows = []
    for wanted in ("7", "asia", "AMER", "a"):
        try:
            rows.append((wanted, ledger.find_one(table(spark, sf_dir, "region"), "r_regionkey", "r_name", wanted).r_name))
        except LookupError as e:
            rows.append((wanted, str(e)))
    return spark.createDataFrame(rows, "wanted string, found string")


@query("ac_next_id", "SELECT max(o_orderkey) + 1 AS next_id FROM orders")
def _(spark, sf_dir):
    return ledger.next_id(table(spark, sf_dir, "orders"), "o_orderkey")
