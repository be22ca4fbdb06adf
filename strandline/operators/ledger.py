"""Double-entry ledger reports over journal legs (account_code, customer_id, txn_id, txn_date, debit_cents, credit_cents)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import money

CASH, RECEIVABLE, REVENUE = 1000, 1100, 4000
EXPENSES = (5000, 5999)

#: The default chart of accounts: fixed codes that reports refer to.
CHART = [
    (1000, "Cash", "asset", "debit"), (1100, "Receivable", "asset", "debit"), (2000, "Payable", "liability", "credit"), (3000, "Equity", "equity", "credit"),
    (3500, "Reserves", "equity", "credit"), (4000, "Revenue", "income", "credit"), (5100, "Operations", "expense", "debit"), (5900, "Other", "expense", "debit"), (9000, "Suspense", "asset", "debit"),
]


def chart(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CHART, "code int, name string, kind string, normal_side string")


def balances(journal: DataFrame, as_of=None) -> DataFrame:
    """What each customer owes: debits less credits on the receivable account up to a day."""
    legs = journal.where((F.col("account_code") == RECEIVABLE) & F.col("customer_id").isNotNull())
    if as_of is not None:
        legs = legs.where(F.col("txn_date") <= F.lit(as_of))
    return legs.groupBy("customer_id").agg(F.sum(F.col("debit_cents") - F.col("credit_cents")).alias("balance_cents"))


def who_owes(journal: DataFrame, at_least: int = 1, as_of=None) -> DataFrame:
    return balances(journal, as_of).where((F.col("balance_cents") >= at_least) & (F.col("balance_cents") > 0)).orderBy(F.desc("balance_cents"), "customer_id")


def trial_balance(journal: DataFrame, total: bool = False) -> DataFrame:
    """Debit, credit and net of each account, and with total a row of all under a null account."""
    sums = [F.sum("debit_cents").alias("debit_cents"), F.sum("credit_cents").alias("credit_cents"), F.sum(F.col("debit_cents") - F.col("credit_cents")).alias("net_cents")]
    return (journal.rollup("account_code") if total else journal.groupBy("account_code")).agg(*sums)


def profit_and_loss(journal: DataFrame, begin=None, end=None, by: list[str] = ()) -> DataFrame:
    """Revenue, expense and what is left, between two days included."""
    legs = journal
    if begin is not None:
        legs = legs.where(F.col("txn_date") >= F.lit(begin))
    if end is not None:
        legs = legs.where(F.col("txn_date") <= F.lit(end))
    earned = F.when(F.col("account_code") == REVENUE, F.col("credit_cents") - F.col("debit_cents")).otherwise(0)
    spent = F.when(F.col("account_code").between(*EXPENSES), F.col("debit_cents") - F.col("credit_cents")).otherwise(0)
    return legs.groupBy(*by).agg(F.sum(earned).alias("revenue_cents"), F.sum(spent).alias("expense_cents"), F.sum(earned - spent).alias("net_cents"))


def unpaid(journal: DataFrame, as_of=None) -> DataFrame:
    """customer_id, bill_date, open_cents of bills still open after credits paid the oldest open ones first.

    A credit with no open bill is lost, not carried on, so what is open follows
    from the running minimum of the balance: the credit that counts up to a leg
    is the running credit less what was lost so far.  Windows alone, so a customer
    with any number of legs spills instead of filling a task.
    """
    legs = journal.where((F.col("account_code") == RECEIVABLE) & F.col("customer_id").isNotNull())
    if as_of is not None:
        legs = legs.where(F.col("txn_date") <= F.lit(as_of))
    w = Window.partitionBy("customer_id").orderBy("txn_date", "txn_id", "leg_seq").rowsBetween(Window.unboundedPreceding, 0)
    run = legs.select("customer_id", "txn_date", "txn_id", "leg_seq", "debit_cents", F.sum(F.col("debit_cents") - F.col("credit_cents")).over(w).alias("net"), F.sum("debit_cents").over(w).alias("billed"))
    lost = run.withColumn("lost", F.greatest(-F.min("net").over(w), F.lit(0)))
    end = lost.groupBy("customer_id").agg(F.max_by(F.struct("net", "lost", "billed"), F.struct("txn_date", "txn_id", "leg_seq")).alias("e"))
    used = end.select("customer_id", (F.col("e.billed") - F.col("e.net") - F.col("e.lost")).alias("used"))
    bills = lost.where("debit_cents > 0").join(used, "customer_id")
    left = F.least(F.col("debit_cents"), F.greatest(F.col("billed") - F.col("used"), F.lit(0)))
    return bills.select("customer_id", F.col("txn_date").alias("bill_date"), left.alias("open_cents")).where("open_cents > 0")


def aging(journal: DataFrame, as_of) -> DataFrame:
    """Open bills of each customer by age on a day: up to 30, 60, 90 days and more."""
    age = F.date_diff(F.lit(as_of).cast("date"), F.col("bill_date").cast("date"))
    held = lambda cond: F.sum(F.when(cond, F.col("open_cents")).otherwise(0))
    out = unpaid(journal, as_of).groupBy("customer_id").agg(
        held(age <= 30).alias("d0_30"), held((age > 30) & (age <= 60)).alias("d31_60"), held((age > 60) & (age <= 90)).alias("d61_90"), held(age > 90).alias("d90_up"), F.sum("open_cents").alias("total_cents")
    )
    return out.where("total_cents <> 0")


def oldest_open(journal: DataFrame, as_of=None) -> DataFrame:
    return unpaid(journal, as_of).groupBy("customer_id").agg(F.min("bill_date").alias("oldest_bill"))


def cycle_totals(expenses: DataFrame) -> DataFrame:
    """Amounts by (cycle_id, account_code) of expenses with cycle_id, next_cycle_id, this_fraction, account_code and amount_cents.

    This cycle takes the fraction, cut to whole cents, and the next one the rest; zero amounts go.
    """
    this = money.scale(F.col("amount_cents"), F.col("this_fraction"))
    halves = F.array(F.struct(F.col("cycle_id").alias("cycle_id"), this.alias("amount")), F.struct(F.col("next_cycle_id").alias("cycle_id"), (F.col("amount_cents") - this).alias("amount")))
    parts = expenses.select("account_code", F.explode(halves).alias("p")).select("account_code", "p.*").where("cycle_id is not null")
    return parts.groupBy("cycle_id", "account_code").agg(F.sum("amount").alias("amount_cents")).where("amount_cents <> 0")


def unbalanced(journal: DataFrame) -> DataFrame:
    """Transactions whose debits and credits differ."""
    return journal.groupBy("txn_id").agg(F.sum("debit_cents").alias("debit_cents"), F.sum("credit_cents").alias("credit_cents")).where("debit_cents <> credit_cents")


def dangling(facts: DataFrame, key: str, dimension: DataFrame, dimension_key: str) -> DataFrame:
    """Rows whose reference names nothing in the dimension; null references refer to nothing on purpose."""
    return facts.where(F.col(key).isNotNull()).join(dimension.select(F.col(dimension_key).alias("_d")), F.col(key) == F.col("_d"), "left_anti")


def active(connections: DataFrame, day: Column, inactive: Column) -> DataFrame:
    """Connections that are active on a day: the last day no longer counts, nor do those named inactive."""
    return connections.where((F.col("first_active") <= day) & (F.col("last_active").isNull() | (day < F.col("last_active"))) & ~F.array_contains(inactive, F.col("connection_id")))


def post(spark: SparkSession, txn_id: int, day, legs: list[dict], source: str = "manual") -> DataFrame:
    """The legs of one transaction as journal rows; they must balance."""
    if sum(x.get("debit_cents", 0) for x in legs) != sum(x.get("credit_cents", 0) for x in legs):
        raise ValueError(f"transaction {txn_id} doesn't balance")
    rows = [(txn_id, str(day), i, x["account_code"], x.get("customer_id"), x.get("debit_cents", 0), x.get("credit_cents", 0), source) for i, x in enumerate(legs)]
    return spark.createDataFrame(rows, "txn_id long, txn_date string, leg_seq int, account_code int, customer_id int, debit_cents long, credit_cents long, source string").withColumn("txn_date", F.col("txn_date").cast("timestamp_ntz"))


def transfer(spark: SparkSession, txn_id: int, day, balance_cents: int, old: int, new: int) -> DataFrame:
    """The legs that move one customer's balance to another, whichever side it is on."""
    amount, side = abs(balance_cents), ("credit_cents", "debit_cents") if balance_cents >= 0 else ("debit_cents", "credit_cents")
    return post(spark, txn_id, day, [{"account_code": RECEIVABLE, "customer_id": old, side[0]: amount}, {"account_code": RECEIVABLE, "customer_id": new, side[1]: amount}], "merge")


def policy_faults(cycles: DataFrame, policies: DataFrame) -> DataFrame:
    """Cycles whose policy doesn't exist, and issued ones whose bill date it doesn't hold on, with the fault."""
    p = policies.select(F.col("policy_id").alias("_policy"), "effective_from", "effective_to")
    found = cycles.join(p, F.col("policy_id") == F.col("_policy"), "left")
    early = F.col("issued") & (F.col("bill_date") < F.col("effective_from"))
    late = F.col("issued") & (F.col("bill_date") > F.col("effective_to"))
    fault = F.when(F.col("_policy").isNull(), "no such policy").when(early, "not yet effective").when(late, "expired")
    return found.withColumn("fault", fault).where("fault is not null").drop("_policy", "effective_from", "effective_to")


def issue_faults(cycles: DataFrame, journal: DataFrame) -> DataFrame:
    """Cycles that are issued without a transaction that has legs, and those with a transaction that aren't issued."""
    legs = journal.select(F.col("txn_id").alias("_txn")).distinct()
    found = cycles.join(legs, F.col("bill_txn_id") == F.col("_txn"), "left")
    fault = (
        F.when(F.col("issued") & F.col("bill_txn_id").isNull(), "issued without a transaction")
        .when(~F.col("issued") & F.col("bill_txn_id").isNotNull(), "a transaction but not issued")
        .when(F.col("issued") & F.col("_txn").isNull(), "no legs")
    )
    return found.withColumn("fault", fault).where("fault is not null").drop("_txn")


class StaleTotals(ValueError):
    """Stored totals aren't those that expenses and rules make now."""


def fresh_cost(stored: DataFrame, fresh: DataFrame, cycle_id: int) -> int:
    """A cycle's cost in cents out of stored totals (cycle_id, account_code, amount_cents), refused if these are behind."""
    stored, fresh = (df.select("cycle_id", "account_code", "amount_cents") for df in (stored, fresh))
    if not (stored.exceptAll(fresh).isEmpty() and fresh.exceptAll(stored).isEmpty()):
        raise StaleTotals("stored cycle totals are behind: refresh them first")
    return stored.where(F.col("cycle_id") == cycle_id).agg(F.coalesce(F.sum("amount_cents"), F.lit(0))).first()[0]


def bill(connections: DataFrame, cost_cents: int, policy: Policy, seed: int) -> DataFrame:
    """connection_id, customer_id and bill_cents of the connections (with weight) that share a cycle's cost.

    Cents that whole shares leave go out in an order that is one for all
    connections, so one cycle's connections, a row each, are shared on the driver.
    """
    rows = connections.select("connection_id", "customer_id", "weight").orderBy("connection_id").collect()
    shares = policy.allocate(cost_cents, [r.weight for r in rows], seed)
    schema = ", ".join(f"{c} {connections.schema[c].dataType.simpleString()}" for c in ("connection_id", "customer_id"))
    return connections.sparkSession.createDataFrame([(r.connection_id, r.customer_id, s) for r, s in zip(rows, shares, strict=True)], f"{schema}, bill_cents long")


def issue(bills: DataFrame, txn_id: int, day) -> DataFrame:
    """The legs of one transaction that posts bills: each customer's receivable against revenue.  A bill that no one holds is an error."""
    if not bills.where("customer_id is null").isEmpty():
        raise ValueError("a connection has no customer")
    zero, amount, nobody = F.lit(0).cast("long"), F.col("bill_cents"), F.lit(None).cast(bills.schema["customer_id"].dataType)

    def leg(account, customer, debit, credit):
        return F.struct(F.lit(account).alias("account_code"), customer.alias("customer_id"), debit.alias("debit_cents"), credit.alias("credit_cents"))

    legs = F.array(leg(RECEIVABLE, F.col("customer_id"), amount, zero), leg(REVENUE, nobody, zero, amount))
    # The legs of one transaction are numbered through, and it is one cycle's.
    out = bills.withColumn("place", F.row_number().over(Window.orderBy("connection_id")) - 1).select("place", F.posexplode(legs).alias("side", "l"))
    return out.select(F.lit(txn_id).cast("long").alias("txn_id"), F.lit(str(day)).cast("timestamp_ntz").alias("txn_date"), (2 * F.col("place") + F.col("side")).alias("leg_seq"), "l.*", F.lit("bill").alias("source"))


def reverse(journal: DataFrame, txn_id: int, new_id: int, day) -> DataFrame:
    """The legs that undo a transaction: the same with debit and credit changed over.  Without legs there is nothing to undo, an error."""
    legs = journal.where(F.col("txn_id") == txn_id)
    if legs.isEmpty():
        raise ValueError(f"transaction {txn_id} has no legs")
    return legs.withColumns({"txn_id": F.lit(new_id).cast("long"), "txn_date": F.lit(str(day)).cast("timestamp_ntz"), "debit_cents": F.col("credit_cents"), "credit_cents": F.col("debit_cents"), "source": F.lit("reversal")})


def drift(recorded: DataFrame, computed: DataFrame) -> DataFrame:
    """Bills that aren't recorded as the policy makes them now: other amounts, not recorded, or recorded without one."""
    r = recorded.select(F.col("connection_id").alias("_r"), F.col("bill_cents").alias("recorded_cents"))
    c = computed.select("connection_id", F.col("bill_cents").alias("computed_cents"))
    both = c.join(r, F.col("connection_id") == F.col("_r"), "full")
    fault = F.when(F.col("_r").isNull(), "not recorded").when(F.col("connection_id").isNull(), "no bill now").when(F.col("recorded_cents") != F.col("computed_cents"), "other amounts")
    return both.select(F.coalesce("connection_id", "_r").alias("connection_id"), "recorded_cents", "computed_cents", fault.alias("fault")).where("fault is not null")


def next_id(df: DataFrame, key: str) -> DataFrame:
    return df.agg((F.coalesce(F.max(key), F.lit(0)) + 1).alias("next_id"))


def find_one(df: DataFrame, key: str, name: str, wanted: str):
    """The one row with this id or name; a name that several rows contain is an error."""
    exact = df.where((F.col(key).cast("string") == wanted) | (F.lower(name) == wanted.lower())).take(2)
    found = exact or df.where(F.contains(F.lower(name), F.lit(wanted.lower()))).take(2)
    if len(found) != 1:
        raise LookupError(f"{wanted!r} {'is ambiguous' if found else 'was not found'}")
    return found[0]


class Policy:
    """How a cycle's cost becomes bills: subclasses are registered by name."""

    registry: dict[str, type] = {}

    def __init_subclass__(cls, name: str, **kwargs):
        super().__init_subclass__(**kwargs)
        Policy.registry[name] = cls

    def allocate(self, total_cents: int, weights: list[float], seed: int) -> list[int]:
        raise NotImplementedError


class ShareByWeight(Policy, name="share-by-weight"):
    """Cost and a margin on it by weight over the weights' sum, or over a denominator of the policy's own."""

    def __init__(self, margin: float = 0.0, denominator: float | None = None):
        self.margin, self.denominator = margin, denominator

    def allocate(self, total_cents: int, weights: list[float], seed: int) -> list[int]:
        total = total_cents + int(total_cents * self.margin)
        return money.allocate(total, weights, self.denominator or sum(weights), seed)
