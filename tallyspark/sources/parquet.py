"""Parquet catalog for production data, and the ingest writer that fills it.

Layout under ``root``: one directory per relation, named as in
``TestdataSource.RELATIONS``, with a folder for each change that wrote to it
(see ``sources.manifest``: readers see a change as a whole or not at all).
The ledger (``ledger_entry``) is written partitioned by ``trn_dt`` so that the
daily reports prune to one directory and the window reports to a handful;
every other relation is a dimension or a snapshot table.

Oracle stores '' as NULL, and several report rules depend on it.  Rather
than wrapping every column read in ``nullif`` (which would stop predicate
push-down into the parquet reader), the ingest step writes NULLs once.
Relations can also live in a second root (the "remote" core-banking source
of some reports); ``ParquetSource(root, remote_root=...)`` reads the ledger,
account and GL tables from there, like a database link would.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions.oracle import MONEY
from tallyspark.session import checkpoint_dir
from tallyspark.sources import derived
from tallyspark.sources.derived import PARTITION_COLUMN
from tallyspark.sources.manifest import Change, Manifest, names_in
from tallyspark.sources.testdata import TestdataSource

REMOTE_RELATIONS = frozenset({
    "ledger_entry", "reversal_entry", "reversal_count", "cash_touch", "entry_key", "first_entry", "hot_key",
    "authorised_daily", "period_balance", "gl_master",
    "account_gl_map", "deposit_term", "account", "account_balance", "account_closure",
})


def blank_strings_to_null(df: DataFrame) -> DataFrame:
    """Map '' to NULL in every string column (Oracle storage rule)."""
    cols = [F.nullif(F.col(f.name), F.lit("")).alias(f.name)
            if isinstance(f.dataType, T.StringType) else F.col(f.name)
            for f in df.schema.fields]
    return df.select(*cols)


#: Columns stored as dates and as money, by the names the relations use.
DATE_SUFFIXES = ("_dt", "_date")
MONEY_SUFFIXES = ("_amount", "_bal", "_amt")


def normalise(df: DataFrame) -> DataFrame:
    """The stored form of a relation: '' is NULL, dates are dates (a timestamp
    is cut to its day; text may be ``2024-05-22`` or ``22-MAY-24``) and money
    is ``decimal(22,3)``.  Text that is no date is an error, not a NULL."""
    cols = []
    for f in blank_strings_to_null(df).schema.fields:
        c = F.col(f.name)
        if f.name.endswith(DATE_SUFFIXES) and isinstance(f.dataType, T.StringType):
            c = F.when(c.rlike(r"^[0-9]{4}-"), F.to_date(c, "yyyy-MM-dd")).otherwise(F.to_date(c, "d-MMM-yy"))
        elif f.name.endswith(DATE_SUFFIXES) and not isinstance(f.dataType, T.DateType):
            c = c.cast("date")
        elif f.name.endswith(MONEY_SUFFIXES) and not isinstance(f.dataType, T.DecimalType):
            c = c.cast(MONEY)
        cols.append(c.alias(f.name))
    return blank_strings_to_null(df).select(*cols)


def _arranged(df: DataFrame, name: str, part: str | None = None) -> DataFrame:
    # REBALANCE lets adaptive execution size the output: a day of a large
    # ledger is split over several files, a small day is not scattered into
    # one file per shuffle partition.
    out = df.hint("rebalance", part) if part else df.hint("rebalance")
    if name == "ledger_entry":
        return out.sortWithinPartitions("trn_ref_no")
    if name == "balance_history":
        # Sorted by account inside a day: row-group statistics let a scan for
        # one account (the vault-cash GL over all history) skip the rest.
        return out.sortWithinPartitions("account")
    return out


def write_relation(df: DataFrame, root: str, name: str, mode: str = "overwrite") -> None:
    """Normalise and store one whole relation (or, with mode ``append``, more
    rows of it); day-grained facts are partitioned by day (the ledger
    additionally clustered by reference inside a day)."""
    change = Change(df.sparkSession, root)
    _put_whole(change, normalise(df), name, add=mode == "append")
    change.publish()


def _put_whole(change: Change, df: DataFrame, name: str, add: bool = False) -> None:
    part = PARTITION_COLUMN.get(name)
    change.put_all(df, name, part, lambda x: _arranged(x, name, part), add)


def _put_day(change: Change, df: DataFrame, name: str, day, add: bool = False) -> None:
    change.put_day(df, name, PARTITION_COLUMN[name], day, lambda x: _arranged(x, name), add)


def replace_day(df: DataFrame, root: str, name: str, day) -> None:
    """Replace one day's partition by ``df`` (already normalised), also by
    nothing: rows that a correction took away do not stay."""
    change = Change(df.sparkSession, root)
    _put_day(change, df, name, day)
    change.publish()


def _rows(change: Change, name: str) -> DataFrame:
    """A side table as the change leaves it; without rows at first."""
    found = change.read(name)
    return derived.empty(change.spark, name) if found is None else found


def _replace_firsts(change: Change, name: str, rows: DataFrame, day) -> None:
    """Bring a first-day table (``name``) up to date for a new, late or
    corrected ``day`` with these ``rows``.

    Affected are the keys of the day's rows and the keys whose stored first
    day is this day.  A key of the rows moves to this day if it was later; a
    key that is no longer in the rows moves to its first day after this one,
    which the per-day key table knows: no ledger row is read.  The partitions
    that lose or get keys are written again, all by one write.
    """
    part, key_table = PARTITION_COLUMN[name], derived.KEYS_OF[name]
    stored, keys = _rows(change, name), _rows(change, key_table)
    key, key_day = next(c for c in stored.columns if c != part), PARTITION_COLUMN[key_table]
    at = F.lit(day).cast("date")
    now = derived.derive(key_table, rows).select(key)
    left = stored.where(F.col(part) == at).select(key).join(now, key, "left_anti")
    later = (keys.where(F.col(key_day) > at).join(left, key, "left_semi")
             .groupBy(key).agg(F.min(key_day).alias(part)))
    earlier = stored.where(F.col(part) < at)
    here = now.join(earlier, key, "left_anti").withColumn(part, at)
    fresh = here.unionByName(later).unionByName(earlier.join(now, key, "left_semi")).checkpoint()
    old = stored.join(now.union(left).distinct(), key).checkpoint()
    moved = old.join(fresh, [key, part], "left_anti").union(fresh.join(old, [key, part], "left_anti"))
    touched = [r[0] for r in moved.select(part).distinct().collect()]  # days, not keys
    if not touched:
        return
    rest = stored.where(F.col(part).isin(touched)).join(old.select(key), key, "left_anti")
    rest = rest.unionByName(fresh.where(F.col(part).isin(touched)))
    change.put_days(rest, name, part, touched, lambda x: _arranged(x, name, part))


# ------------------------------------------------------------ balance periods
def period_end(day: date, period: str) -> date:
    """The last day of the period (``month`` or ``week``) of a day."""
    if period == "week":
        return day + timedelta(6 - day.weekday())
    if period == "month":
        return (day.replace(day=28) + timedelta(4)).replace(day=1) - timedelta(1)
    raise ValueError(f"unknown period {period!r}")


def _summed(rows: DataFrame) -> DataFrame:
    """Sums per account, leg and currency; ``n_days`` counts the daily rows in
    them, so a balance whose rows were all taken away is told from one of 0."""
    sums = [F.sum(c).cast("decimal(38,3)").alias(c) for c in derived.SIDES]
    return rows.groupBy(*derived.POSITION).agg(*sums, F.sum("n_days").alias("n_days"))


def _closing(rows: DataFrame) -> DataFrame:
    return _summed(rows).where(F.col("n_days") != 0)


def _as_balance(daily: DataFrame, sign: int = 1) -> DataFrame:
    zero = F.lit(0).cast("decimal(38,3)")
    return daily.select(*derived.POSITION, *((F.coalesce(F.col(c).cast("decimal(38,3)"), zero) * sign)
                                             .cast("decimal(38,3)").alias(c) for c in derived.SIDES),
                        F.lit(sign).cast("long").alias("n_days"))


#: Corrections that a closed period holds beside its balances before these
#: are summed up anew.
MOST_CORRECTIONS = 16


def _update_balances(change: Change, was: DataFrame | None = None, now: DataFrame | None = None, day=None) -> None:
    """Keeps ``period_balance`` right: its partition of a closed period holds
    the balances of all days up to the period's end.

    A day inside closed periods adds the difference between its new and its
    old rows to each of them; balances are sums, so nothing else of them is
    read.  Periods that have become closed (the ledger has later days) are
    summed up from the last one before and the days since.
    """
    name, part = "period_balance", PARTITION_COLUMN["period_balance"]
    closed = [date.fromisoformat(d) for d in change.after.days(name)]
    if day is not None and closed and closed[-1] >= day:
        differs = F.greatest(*(F.abs(c) for c in (*derived.SIDES, "n_days"))) != 0
        correction = _summed(_as_balance(now).unionByName(_as_balance(was, -1))).where(differs).checkpoint()
        if not correction.isEmpty():
            held = change.after.relations[name]["folders"]
            for end in (e for e in closed if e >= day):
                if len(held[str(end)]) <= MOST_CORRECTIONS:
                    _put_day(change, correction, name, end, add=True)
                else:
                    balances = change.read(name).where(F.col(part) == F.lit(end)).drop(part)
                    _put_day(change, _closing(balances.unionByName(correction)), name, end)
    days = [date.fromisoformat(d) for d in change.after.days("authorised_daily")]
    if not days:
        return
    ends = sorted({period_end(d, change.after.period) for d in days if period_end(d, change.after.period) < days[-1]})
    for end in ends:
        if end in closed:
            continue
        before = max((e for e in change.after.days(name) if e < str(end)), default=None)
        rows = _as_balance(change.read("authorised_daily").where(
            (F.col("trn_dt") <= F.lit(end)) & (F.lit(before is None) | (F.col("trn_dt") > F.lit(before).cast("date")))))
        if before is not None:
            rows = rows.unionByName(change.read(name).where(F.col(part) == F.lit(before).cast("date")).drop(part))
        _put_day(change, _closing(rows), name, end)


# ------------------------------------------------------------ daily ingest
def _ingest(rows: DataFrame, root: str, facts: str, per_day, firsts: str, day, period: str | None) -> None:
    part, spark, day = PARTITION_COLUMN[facts], rows.sparkSession, date.fromisoformat(str(day))
    checkpoint_dir(spark)
    rows = normalise(rows).checkpoint()
    others = rows.where(~F.col(part).eqNullSafe(F.lit(day).cast("date"))).count()
    if others:
        raise ValueError(f"{others} rows of {facts} are not of {day}: each day is stored by itself")
    change = Change(spark, root)
    change.after.period = change.after.period or period
    sums = change.read("authorised_daily") if "authorised_daily" in per_day else None
    for name in per_day:
        _put_day(change, derived.derive(name, rows), name, day)
    _replace_firsts(change, firsts, rows, day)
    if "authorised_daily" in per_day:
        now = derived.authorised_daily(rows)
        was = now.limit(0) if sums is None else sums.where(F.col("trn_dt") == F.lit(day).cast("date"))
        _update_balances(change, was, now, day)
    _put_day(change, rows, facts, day)
    change.publish()  # readers see the day and all its side rows from here on


def ingest_day(ledger_day: DataFrame, root: str, day, period: str = "month") -> None:
    """Store one posting day of the ledger and its part of every side table;
    an earlier version of the day is replaced.  Days may come late, again, or
    in corrected form: afterwards each side table equals the one derived from
    the stored ledger.  Rows of another day, or without one, are an error.

    All of it becomes visible at once, by the manifest that is published last;
    a run that breaks off anywhere leaves the old state and is repeated.
    ``period`` is how long the stored balance periods are, fixed by the first
    ingest.
    """
    _ingest(ledger_day, root, "ledger_entry", derived.PER_DAY, "first_entry", day, period)


def ingest_snapshot_day(history_day: DataFrame, root: str, day) -> None:
    """Store one day of the balance history and bring its side tables up to
    date (see ``ingest_day``)."""
    _ingest(history_day, root, "balance_history", ("snapshot_key",), "first_snapshot", day, None)


class ParquetSource:
    """``table(name)`` reads ``root/name`` (or ``remote_root/name``).

    The manifests are resolved once per source object, so all relations that
    it reads are of one state.  A relation that no manifest lists is read as a
    plain folder.
    """

    RELATIONS = (*TestdataSource.RELATIONS, "period_balance")

    def __init__(self, spark: SparkSession, root: str, remote_root: str | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.remote_root = (remote_root or root).rstrip("/")
        self._memo: dict[str, DataFrame] = {}
        self._manifests: dict[str, Manifest] = {}

    def _base(self, name: str) -> tuple[str, Manifest]:
        base = self.remote_root if name in REMOTE_RELATIONS else self.root
        if base not in self._manifests:
            self._manifests[base] = Manifest.latest(self.spark, base)
        return base, self._manifests[base]

    def table(self, name: str) -> DataFrame:
        """The relation as a lazy scan; listed once per source object (a
        report reads some relations several times)."""
        if name not in self.RELATIONS:
            raise KeyError(f"unknown relation {name!r}")
        if name not in self._memo:
            base, manifest = self._base(name)
            if name in manifest.relations:
                self._memo[name] = manifest.read(self.spark, base, name)
            elif name in derived.SCHEMAS and not names_in(self.spark, f"{base}/{name}"):
                self._memo[name] = derived.empty(self.spark, name)
            else:
                self._memo[name] = self.spark.read.parquet(f"{base}/{name}")
        return self._memo[name]

    __call__ = table

    def last_period_end(self, day: date) -> date | None:
        """The end of the last closed balance period up to ``day``."""
        ends = [d for d in self._base("period_balance")[1].days("period_balance") if d <= day.isoformat()]
        return date.fromisoformat(ends[-1]) if ends else None


def materialize(source, root: str, names=None, period: str = "month") -> ParquetSource:
    """Write every relation of ``source`` under ``root``, as one change, and
    return a catalog over the written copy (used to cut long lineage and for
    the bench)."""
    change = Change(source.spark, root)
    change.after.period = change.after.period or period
    # Side tables are derived from the relation just stored, not once more
    # from the source.
    for name in sorted(names or source.RELATIONS, key=lambda n: n in derived.DERIVED):
        origin = derived.DERIVED_FROM.get(name, "ledger_entry")
        if name in derived.DERIVED and (not names or origin in names):
            _put_whole(change, derived.derive(name, change.read(origin)), name)
        else:
            _put_whole(change, normalise(source.table(name)), name)
    if not names or "authorised_daily" in names:
        _update_balances(change)
    change.publish()
    return ParquetSource(source.spark, root)
