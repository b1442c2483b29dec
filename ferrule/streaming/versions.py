"""A versioned change log: snapshots, own writes, validated batch commits, compaction.

Every write is a row of (epoch, tid, op, key, values); ``op`` is 'put' or 'del'.  A snapshot at an epoch takes each key's
newest version up to it and drops deletes.  Commits are batches by one writer: they validate what was read
against what has been committed since, then append a commit directory in one rename.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PUT, DELETE = "put", "del"
#: The newest version of a key on its way through a plan.
_V = "__newest"


class Conflict(RuntimeError):
    """A commit whose reads are no longer true."""


class DuplicateKey(RuntimeError):
    """An insert of a key that exists, or two rows of one unique key."""


def snapshot(log: DataFrame, key: Sequence[str], epoch: int | None = None, order: Sequence[str] = ("epoch", "tid")) -> DataFrame:
    """The rows of the log's table as of the end of an epoch.

    One aggregation with partial sums: the newest version of a key is the maximum by (epoch, tid), never a sort of its
    history.
    """
    seen = log if epoch is None else log.where(F.col("epoch") <= epoch)
    values = [c for c in log.columns if c not in (*key, *order, "op")]
    newest = seen.groupBy(*key).agg(F.max_by(F.struct("op", *values), F.struct(*order)).alias(_V))
    return newest.where(F.col(f"{_V}.op") == PUT).select(*key, *[F.col(f"{_V}.{c}").alias(c) for c in values])


def own_writes(base: DataFrame, pending: DataFrame, key: Sequence[str]) -> DataFrame:
    """What a transaction sees: committed rows under its own pending puts and deletes (with columns tid and op)."""
    values = [c for c in base.columns if c not in key]
    committed = base.select(*key, *values, F.lit(-1).cast("long").alias("tid"), F.lit(PUT).alias("op"))
    both = committed.unionByName(pending.select(*key, *values, F.col("tid").cast("long").alias("tid"), "op"))
    newest = both.groupBy(*key).agg(F.max_by(F.struct("op", *values), "tid").alias(_V))
    return newest.where(F.col(f"{_V}.op") == PUT).select(*key, *[F.col(f"{_V}.{c}").alias(c) for c in values])


def unique_violations(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values of a unique key, all parts of it not null, that more than one row holds."""
    full = rows.dropna(subset=list(columns))
    return full.groupBy(*columns).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def changed_reads(reads: DataFrame, current: DataFrame, key: Sequence[str]) -> DataFrame:
    """Point reads (key, tid; tid null: not found) whose version has changed."""
    now = current.select(*key, F.col("tid").alias("now"))
    return reads.join(now, list(key), "left").where(~F.col("tid").eqNullSafe(F.col("now"))).select(*key)


def changed_range(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that came, went or changed in a range that was read (key, tid): phantoms included."""
    b = before.select(*key, F.col("tid").alias("b"))
    a = after.select(*key, F.col("tid").alias("a"))
    return b.join(a, list(key), "full").where(~F.col("a").eqNullSafe(F.col("b"))).select(*key)


def _values(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> list[str]:
    return [c for c in rows.columns if c not in (*key, *order)]


def duplicate_keys(base: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys of ``rows`` that an insert into ``base`` must refuse: those that are there, and those that come twice."""
    batch = rows.groupBy(*key).agg((F.count("*") > 1).alias("again"))
    there = base.select(*key).distinct().withColumn("there", F.lit(True))
    return batch.join(there, list(key), "left").where("again OR there").select(*key)


def insert_ignored(base: DataFrame, rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """What an insert that skips duplicates adds: of each new key the first row by ``order``."""
    values = _values(rows, key, order)
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*values), F.struct(*order, *values)).alias(_V))
    return first.select(*key, *[F.col(f"{_V}.{c}").alias(c) for c in values]).join(base.select(*key), list(key), "left_anti")


def replaced(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """What a replace puts: of each key the last row by ``order``."""
    values = _values(rows, key, order)
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*values), F.struct(*order, *values)).alias(_V))
    return last.select(*key, *[F.col(f"{_V}.{c}").alias(c) for c in values])


def upserted(base: DataFrame, rows: DataFrame, key: Sequence[str], order: Sequence[str], change: Callable[[Column, Column], dict[str, Column]]) -> DataFrame:
    """What an insert with an update of duplicates puts: each key's rows go, by ``order``, into the row that is there.

    ``change(old, new)`` gives the columns that a duplicate changes, from the row there and the row that was to be
    inserted; a key that is not there begins with its first row.  The rows of one key in one statement are gathered.
    """
    values = _values(rows, key, order)
    kinds = dict(base.dtypes)
    cast = [F.col(c).cast(kinds[c]).alias(c) for c in values]
    batch = rows.select(*key, *order, *cast).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*order, *values))).alias("all"))
    old = base.select(*key, F.struct(*[F.col(c) for c in values]).alias("old"))
    both = batch.join(old, list(key), "left")
    plain = F.transform("all", lambda x: F.struct(*[x[c].alias(c) for c in values]))
    start, more = F.coalesce("old", plain[0]), F.when(F.col("old").isNull(), F.slice(plain, 2, F.size("all"))).otherwise(plain)

    def fold(have: Column, new: Column) -> Column:
        changed = change(have, new)
        return F.struct(*[changed.get(c, have[c]).cast(kinds[c]).alias(c) for c in values])

    out = both.select(*key, F.aggregate(more, start, fold).alias(_V))
    return out.select(*key, *[F.col(f"{_V}.{c}").alias(c) for c in values])


def changed_columns(reads: DataFrame, current: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Point reads of some columns (key, columns) that are no longer true; a change of other columns is no conflict."""
    now = current.select(*key, F.struct(*columns).alias("__now"))
    same = F.col("__now").isNotNull() & F.struct(*columns).eqNullSafe(F.col("__now"))
    return reads.join(now, list(key), "left").where(~same).select(*key)


@dataclass
class Transaction:
    """Reads and writes to be committed together."""

    begun: int
    writes: list[DataFrame] = field(default_factory=list)
    reads: list[DataFrame] = field(default_factory=list)
    #: Versions that inserts of this transaction met; they can only have changed if somebody has committed since.
    met: list[DataFrame] = field(default_factory=list)
    ranges: list[tuple] = field(default_factory=list)


class ChangeLog:
    """A table as a log of Parquet commits under a folder; a reader's snapshot never changes, one writer appends.

    ``values`` is the DDL of the columns beyond the key.  Readers go by the commits that are complete; a commit becomes
    so by the rename of its folder.
    """

    def __init__(self, spark: SparkSession, path: str, key: dict[str, str], values: dict[str, str], unique: Sequence[Sequence[str]] = ()):
        self.spark, self.path, self.key, self.unique = spark, path.rstrip("/"), list(key), unique
        self.values = list(values)
        self.kinds = {**key, **values}
        self.indexes: dict[str, tuple[list[str], ChangeLog]] = {}
        self.schema = "epoch long, tid long, op string, " + ", ".join(f"{c} {t}" for c, t in {**key, **values}.items())
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.path))

    def _commits(self) -> dict[int, str]:
        """Newest base and the commits after it, by epoch."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))]
        base = max((int(n[5:]) for n in names if n.startswith("base-")), default=None)
        found = {int(n[6:]): n for n in names if n.startswith("epoch-") and (base is None or int(n[6:]) > base)}
        return ({base: f"base-{base:020d}"} if base is not None else {}) | found

    def epoch(self) -> int:
        return max(self._commits(), default=0)

    def log(self) -> DataFrame:
        """All versions that are kept; a torn commit has no folder and is not seen."""
        paths = [f"{self.path}/{n}" for n in self._commits().values()]
        empty = self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else empty

    def read(self, epoch: int | None = None) -> DataFrame:
        return snapshot(self.log(), self.key, epoch)

    def _of(self, keys: DataFrame | None, epoch: int | None = None) -> DataFrame:
        """The log up to an epoch, of some keys only if given: a small batch does not aggregate the whole history."""
        log = self.log() if epoch is None else self.log().where(F.col("epoch") <= epoch)
        return log if keys is None else log.join(keys.select(*self.key).distinct(), self.key, "left_semi")

    def versions(self, keys: DataFrame | None = None, epoch: int | None = None) -> DataFrame:
        """Live keys, of ``keys`` if given, with the tid that wrote them."""
        rows = self._of(keys, epoch).groupBy(*self.key).agg(F.max_by(F.struct("op", "tid"), F.struct("epoch", "tid")).alias(_V))
        return rows.where(F.col(f"{_V}.op") == PUT).select(*self.key, F.col(f"{_V}.tid").alias("tid"))

    def begin(self) -> Transaction:
        return Transaction(self.epoch())

    def insert(
        self,
        t: Transaction,
        rows: DataFrame,
        ignore: bool = False,
        replace: bool = False,
        update: Callable[[Column, Column], dict[str, Column]] | None = None,
        order: Sequence[str] = (),
    ) -> None:
        """Puts of new keys, in the transaction's own view.

        A key that is there already, or twice among ``rows``, raises at once, is left out (``ignore``: the first row by
        ``order`` stays), is replaced (``replace``: the last one) or changes the row that is there (``update``, see
        ``upserted``).  Without ``order`` rows of a key follow each other by their values.  The versions that were met are
        reads of the transaction: a key that somebody else commits meanwhile is a conflict.
        """
        rows = rows.select(*self.key, *[c for c in order if c not in (*self.key, *self.values)], *self.values)
        keys = rows.select(*self.key).distinct()
        there = self.view(t, keys)
        order = [c for c in order if c not in self.values]
        by = order or list(self.values)
        if ignore or replace or update:
            plain = rows if order else rows.select("*", F.lit(0).alias(free := "n" + "_" * max(map(len, rows.columns))))
            by = order or [free]
            new = insert_ignored(there, plain, self.key, by) if ignore else replaced(plain, self.key, by) if replace else upserted(there, plain, self.key, by, update)
        else:
            if not duplicate_keys(there, rows, self.key).isEmpty():
                raise DuplicateKey("the key exists")
            new = rows
        t.met.append(keys.join(self.versions(keys, t.begun), self.key, "left").select(*self.key, "tid"))
        t.writes.append(new.select(*self.key, *self.values).withColumn("op", F.lit(PUT)))

    def update(self, t: Transaction, rows: DataFrame, old_keys: DataFrame | None = None) -> None:
        """New versions; if keys move, the old ones are deleted."""
        if old_keys is not None:
            self.delete(t, old_keys.join(rows.select(*self.key), self.key, "left_anti"))
        t.writes.append(rows.select(*self.key, *self.values).withColumn("op", F.lit(PUT)))

    def delete(self, t: Transaction, keys: DataFrame) -> None:
        kinds = dict(self.spark.createDataFrame([], self.schema).dtypes)
        t.writes.append(keys.select(*self.key, *[F.lit(None).cast(kinds[c]).alias(c) for c in self.values], F.lit(DELETE).alias("op")))

    def pending(self, t: Transaction) -> DataFrame | None:
        """A transaction's writes, later ones of a key over earlier ones."""
        out = None
        for i, w in enumerate(t.writes):
            w = w.withColumn("tid", F.lit(i).cast("long"))
            out = w if out is None else out.unionByName(w)
        return out

    def view(self, t: Transaction, keys: DataFrame | None = None) -> DataFrame:
        """What the transaction sees, of some keys only if given."""
        p, base = self.pending(t), snapshot(self._of(keys, t.begun), self.key)
        if p is not None and keys is not None:
            p = p.join(keys.select(*self.key).distinct(), self.key, "left_semi")
        return base if p is None else own_writes(base, p, self.key)

    def commit(self, t: Transaction) -> int:
        """Validate and append; the new epoch.  Raises ``Conflict`` or ``DuplicateKey`` and writes nothing then."""
        epoch = self.epoch() + 1
        for r in [*t.reads, *(t.met if epoch > t.begun + 1 else ())]:
            if not changed_reads(r, self.versions(r), self.key).isEmpty():
                raise Conflict("a row that was read has changed")
        for seen, condition in t.ranges:
            if not changed_range(seen, self.versions().where(condition), self.key).isEmpty():
                raise Conflict("a range that was read has changed")
        p = self.pending(t)
        if p is None:
            return self.epoch()
        newest = p.groupBy(*self.key).agg(F.max_by(F.struct("op", *self.values), "tid").alias(_V))
        puts = newest.where(F.col(f"{_V}.op") == PUT).select(*self.key, *[F.col(f"{_V}.{c}").alias(c) for c in self.values])
        for u in self.unique:
            # only rows whose values are written can clash with them
            state = self.read().join(newest.select(*self.key), self.key, "left_anti").unionByName(puts)
            if not unique_violations(state.join(puts.select(*u).distinct(), list(u), "left_semi"), u).isEmpty():
                raise DuplicateKey(", ".join(u))
        rows = newest.select(
            F.lit(epoch).cast("long").alias("epoch"), F.lit(epoch).cast("long").alias("tid"), F.col(f"{_V}.op").alias("op"), *self.key, *[F.col(f"{_V}.{c}").alias(c) for c in self.values]
        )
        # entries come before the rows that they name and go after them: readers find too many at most
        moved = {} if not self.indexes else {n: self._entries_moved(n, newest, puts) for n in self.indexes}
        for n, (new, _) in moved.items():
            self.indexes[n][1]._append(new, PUT)
        self._publish(rows, f"epoch-{epoch:020d}")
        for n, (_, old) in moved.items():
            self.indexes[n][1]._append(old, DELETE)
        return epoch

    def _append(self, keys: DataFrame, op: str) -> None:
        """Unconditional puts or deletes of keys without values."""
        epoch = self.epoch() + 1
        marks = [F.lit(epoch).cast("long").alias("epoch"), F.lit(epoch).cast("long").alias("tid"), F.lit(op).alias("op")]
        self._publish(keys.select(*marks, *self.key), f"epoch-{epoch:020d}")

    def _entries_moved(self, name: str, newest: DataFrame, puts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Index entries that a commit makes, and those that it ends."""
        columns = self.indexes[name][0]
        old = snapshot(self._of(newest), self.key).select(*columns, *self.key)
        new = puts.select(*columns, *self.key)
        return new.exceptAll(old), old.exceptAll(new)

    def add_index(self, name: str, columns: Sequence[str]) -> None:
        """A secondary index, as a log of (columns, key) of its own; filled from the rows that are there, kept up by commits."""
        kinds = {c: self.kinds[c] for c in [*columns, *self.key]}
        index = ChangeLog(self.spark, f"{self.path}/.index-{name}", kinds, {})
        self.indexes[name] = (list(columns), index)
        if not index.epoch():
            index._append(self.read().select(*index.key), PUT)

    def drop_index(self, name: str) -> None:
        _, index = self.indexes.pop(name)
        self._fs.delete(self._path(index.path), True)

    def read_index(self, name: str, condition: Column) -> DataFrame:
        """Rows whose indexed columns meet a condition: it is pushed to the index, whose keys choose the rows."""
        entries = snapshot(self.indexes[name][1].log().where(condition), self.indexes[name][1].key)
        return snapshot(self._of(entries), self.key).where(condition)

    def _publish(self, rows: DataFrame, name: str) -> None:
        """Written aside, then renamed: readers see all of it or none."""
        aside = f"{self.path}/.{uuid.uuid4().hex}"
        rows.write.parquet(aside)
        target = self._path(f"{self.path}/{name}")
        if self._fs.exists(target) or not self._fs.rename(self._path(aside), target):
            self._fs.delete(self._path(aside), True)
            raise Conflict("another writer committed this epoch")

    def checkpoint(self) -> int:
        """Write the state of the newest epoch as a base and drop the commits below it."""
        epoch = self.epoch()
        newest = self.log().groupBy(*self.key).agg(F.max_by(F.struct("epoch", "tid", "op", *self.values), F.struct("epoch", "tid")).alias(_V))
        rows = newest.where(F.col(f"{_V}.op") == PUT).select(F.col(f"{_V}.epoch").alias("epoch"), F.col(f"{_V}.tid").alias("tid"), F.col(f"{_V}.op").alias("op"), *self.key, *[F.col(f"{_V}.{c}").alias(c) for c in self.values])
        old = [n for e, n in self._commits().items() if e <= epoch]
        name = f"base-{epoch:020d}"
        if name in old:
            return epoch
        self._publish(rows, name)
        for n in old:
            self._fs.delete(self._path(f"{self.path}/{n}"), True)
        return epoch


def tail(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The log's commits as a stream, for followers that keep a copy."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(path)
