"""A rollup store of immutable deltas: a commit is one exclusively created manifest.

Layout under the root: ``data/<id>`` (rollup deltas, Parquet), ``ledger/ident=<id>/day=<day>`` (claims), ``commits/<tenant>/<n>.json``. A manifest
names the data and claims that became visible with revision ``n`` of its tenant. Readers see only what manifests name, so
rollups and claims appear together or not at all; losing the race for a number means looking at the claims again. Deltas merge
on read, because merging is associative. Compaction and retention write a delta that replaces others, under a new manifest.

A manifest is written under a private name and gets its number complete. Every ``BASE_EVERY``-th one also lists all that is live, so
that a reader opens a bounded number of them. Claims are partitioned by the day of their window. ``vacuum`` deletes files that
were replaced, and manifests that a base covers, once they are older than any reader.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from urllib.parse import quote, unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.query import MAX_CHANGE_BYTES, cost
from tidewell.operators.rollup import COLUMNS, merge
from tidewell.schema import KEY, LEDGER, ROLLUP

CLAIM = ["tenant_id", "batch_id", "window_start"]
DATA = f"{ROLLUP}, revision bigint"
CLAIMS = f"{LEDGER}, processed_at timestamp"
BASE_EVERY = 32


def _day(at: Column) -> Column:
    """The UTC day of a time, whatever zone a session has."""
    return F.date_from_unix_date(F.floor(F.unix_micros(at.cast("timestamp")) / 86_400_000_000).cast("int"))


class Conflict(Exception):
    """Some of the claims are committed already; nothing was written."""


@dataclass(frozen=True, order=True)
class Cursor:
    """Keyset position of a change feed."""

    revision: int = 0
    metric: str = ""
    kind: str = ""
    label_hash: str = ""
    window_start: datetime | None = None


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    # Files ----------------------------------------------------------------------------------------------------------
    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def _create(self, name: str, text: str) -> bool:
        """Write a file unless it exists: complete under a private name, then named in one exclusive step."""
        folder, _, last = name.rpartition("/")
        target, private = self._path(name), self._path(f"{folder}/.{last}.{uuid.uuid4().hex}")
        out = self._fs.create(private, False)
        out.write(text.encode())
        out.close()
        jvm = self.spark._jvm
        try:
            if self._fs.getScheme() == "file":
                # A local rename would replace what is there; a link does not.
                at = lambda p: jvm.java.nio.file.Paths.get(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
                jvm.java.nio.file.Files.createLink(at(target), at(private))
            else:
                none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(private, target, none)
            return True
        except Py4JJavaError as e:
            if "Exist" in e.java_exception.getClass().getSimpleName():
                return False
            raise
        finally:
            self._fs.delete(private, False)

    def _read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    # Manifests ------------------------------------------------------------------------------------------------------
    def tenants(self) -> list[str]:
        return [unquote(x) for x in self._names("commits")]

    def _folder(self, tenant: str) -> str:
        return f"commits/{quote(tenant, safe='')}"

    def _numbers(self, tenant: str) -> list[int]:
        return [int(n[:-5]) for n in self._names(self._folder(tenant)) if n.endswith(".json") and not n.startswith(".")]

    def _manifest(self, tenant: str, n: int) -> dict:
        return json.loads(self._read(f"{self._folder(tenant)}/{n:012d}.json"))

    def revision(self, tenant: str) -> int:
        return max(self._numbers(tenant), default=0)

    def _state(self, tenant: str, at: int | None = None) -> dict[str, list[tuple[str, int]]]:
        """What is live at a revision: (folder, revision) of data and claims, from the last base on."""
        numbers = [n for n in self._numbers(tenant) if at is None or n <= at]
        base = max((n for n in numbers if n % BASE_EVERY == 0), default=0)
        live: dict[str, list[tuple[str, int]]] = {"data": [], "claims": []}
        for n in sorted(n for n in numbers if n >= base):
            found = self._manifest(tenant, n)
            if n == base:
                live = {k: [(x, i) for x, i in found["base"][k]] for k in live}
                continue
            live = self._after(live, found, n)
        return live

    @staticmethod
    def _after(live: dict, manifest: dict, n: int) -> dict:
        return {k: [x for x in v if x[0] not in manifest.get(f"old_{k}", [])] + ([(manifest[k], n)] if manifest.get(k) else []) for k, v in live.items()}

    def _live(self, tenant: str, what: str) -> list[tuple[str, int]]:
        return self._state(tenant)[what]

    def _publish(self, tenant: str, manifest: dict, after: int) -> int | None:
        n = after + 1
        if n % BASE_EVERY == 0:
            manifest = manifest | {"base": self._after(self._state(tenant, after), manifest, n)}
        return n if self._create(f"{self._folder(tenant)}/{n:012d}.json", json.dumps(manifest)) else None

    def vacuum(self, tenant: str, now: datetime, older: timedelta = timedelta(days=1)) -> int:
        """Delete folders that are no longer live, and manifests before the last base, if they are ``older``; returns how many.

        Folders that no manifest names are commits that lost or are under way; age tells the former.
        """
        limit, gone = int((now - older).timestamp() * 1000), 0
        numbers = self._numbers(tenant)
        base = max((n for n in numbers if n % BASE_EVERY == 0), default=0)
        state = self._state(tenant)
        named = {k: {m[x] for n in numbers for m in [self._manifest(tenant, n)] for x in (k, f"old_{k}") if isinstance(m.get(x), str)} | {y for n in numbers for y in self._manifest(tenant, n).get(f"old_{k}", [])} for k in state}
        for kind, folder in (("data", "data/"), ("claims", "ledger/ident=")):
            for x in named[kind] - {x for x, _ in state[kind]}:
                path = self._path(f"{folder}{x}")
                if self._fs.exists(path) and self._fs.getFileStatus(path).getModificationTime() <= limit:
                    gone += self._fs.delete(path, True)
        for n in numbers:
            path = self._path(f"{self._folder(tenant)}/{n:012d}.json")
            if n < base and self._fs.getFileStatus(path).getModificationTime() <= limit:
                gone += self._fs.delete(path, False)
        return gone

    # Reading --------------------------------------------------------------------------------------------------------
    def deltas(self, tenant: str, since: int = 0) -> DataFrame:
        """All visible deltas with the revision that made each row visible; one scan over all files."""
        live = [(x, n) for x, n in self._live(tenant, "data") if n > since]
        if not live:
            return self.spark.createDataFrame([], DATA)
        rows = self.spark.read.schema(DATA).parquet(*[f"{self.root}/data/{x}" for x, _ in live])
        ident = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        numbers = F.broadcast(self.spark.createDataFrame(live, "_ident string, _n long"))
        rows = rows.withColumn("_own", ident).join(numbers, F.col("_own") == F.col("_ident"))
        return rows.withColumn("revision", F.coalesce("revision", "_n")).drop("_own", "_ident", "_n")

    def rollups(self, tenant: str) -> DataFrame:
        """Current rollups. A single delta, as compaction leaves it, has each key once: a plain scan, which filters reach."""
        rows = self.deltas(tenant)
        return rows if len(self._live(tenant, "data")) == 1 else merge(rows)

    def ledger(self, tenant: str, first: datetime | None = None, last: datetime | None = None) -> DataFrame:
        """Claims, of the days from ``first`` to ``last`` only where those are given."""
        live = self._live(tenant, "claims")
        if not live:
            return self.spark.createDataFrame([], CLAIMS)
        rows = self._claims([x for x, _ in live])
        if first is not None:
            rows = rows.where(F.col("day") >= _day(F.lit(first)))
        if last is not None:
            rows = rows.where(F.col("day") <= _day(F.lit(last)))
        return rows.drop("day")

    def _claims(self, idents: list[str]) -> DataFrame:
        rows = self.spark.read.schema(f"{CLAIMS}, ident string, day date").option("basePath", f"{self.root}/ledger")
        return rows.parquet(*[f"{self.root}/ledger/ident={x}" for x in idents]).drop("ident")

    def committed(self, claims: DataFrame, tenant: str) -> DataFrame:
        """Those of the claims that the ledger has."""
        first, last = claims.agg(F.min("window_start"), F.max("window_start")).first()
        return claims.join(self.ledger(tenant, first, last), CLAIM, "left_semi")

    def _write_claims(self, rows: DataFrame, ident: str) -> None:
        rows.withColumn("day", _day(F.col("window_start"))).write.partitionBy("day").parquet(f"{self.root}/ledger/ident={ident}")

    # Writing --------------------------------------------------------------------------------------------------------
    def commit(self, tenant: str, rollups: DataFrame, claims: DataFrame, now: datetime, attempts: int = 20) -> int:
        """Make rollups and claims visible together; returns the revision, or raises ``Conflict``.

        Without rollups nothing is written and no revision is taken.
        """
        ident = uuid.uuid4().hex
        rollups = rollups.select(*COLUMNS).withColumn("revision", F.lit(None).cast("long"))
        rollups.sortWithinPartitions("metric", "window_start").write.parquet(f"{self.root}/data/{ident}")
        if self.spark.read.schema(DATA).parquet(f"{self.root}/data/{ident}").isEmpty():
            return self.revision(tenant)
        self._write_claims(claims.select(*CLAIM).distinct().withColumn("processed_at", F.lit(now).cast("timestamp")), ident)
        own = self._claims([ident]).drop("day")
        for _ in range(attempts):
            at = self.revision(tenant)
            if not self.committed(own, tenant).isEmpty():
                raise Conflict(tenant)
            if n := self._publish(tenant, {"data": ident, "claims": ident}, at):
                return n
        raise Conflict(f"{tenant}: no free revision in {attempts} attempts")

    def _rewrite(self, tenant: str, kind: str, rows: DataFrame, replaced: list[str], at: int) -> bool:
        ident = uuid.uuid4().hex
        if kind == "data":
            rows.sortWithinPartitions("metric", "window_start").write.parquet(f"{self.root}/data/{ident}")
        else:
            self._write_claims(rows, ident)
        return self._publish(tenant, {kind: ident, f"old_{kind}": replaced}, at) is not None

    def compact(self, tenant: str, keep_after: datetime | None = None) -> bool:
        """Merge all deltas into one; rows keep their newest revision. Windows that ended before ``keep_after`` are left out."""
        at, live = self.revision(tenant), [x for x, _ in self._live(tenant, "data")]
        if not live:
            return False
        rows = self.rollups(tenant)
        if keep_after is not None:
            rows = rows.where(F.col("window_end") >= F.lit(keep_after).cast("timestamp"))
        return self._rewrite(tenant, "data", rows.select(*COLUMNS, "revision"), live, at)

    def expire_ledger(self, tenant: str, keep_after: datetime) -> bool:
        at, live = self.revision(tenant), [x for x, _ in self._live(tenant, "claims")]
        if not live:
            return False
        rows = self.ledger(tenant).where(F.col("processed_at") >= F.lit(keep_after).cast("timestamp"))
        return self._rewrite(tenant, "claims", rows, live, at)

    # Change feed ----------------------------------------------------------------------------------------------------
    def changes(self, tenant: str, cursor: Cursor, limit: int = 1000, budget: int = MAX_CHANGE_BYTES, metric: str | None = None) -> DataFrame:
        """A page of changes; ``ValueError`` where a single row exceeds the byte budget, which no page could hold."""
        page = change_page(self.deltas(tenant), cursor, limit, budget, metric).cache()
        first = page.limit(1).withColumn("cost", cost(page)).first()
        if first is not None and first["cost"] > budget:
            page.unpersist()
            raise ValueError(f"a row of {first['cost']} bytes exceeds the budget of {budget}")
        return page

    def tail(self, tenant: str, metric: str | None = None, labels: dict[str, str] | None = None, polls: int | None = None, wait: Callable[[], None] = lambda: None) -> Iterator[list]:
        """What changed since each poll before, from the newest revision on: a list of rows a poll, each key once with its current totals."""
        cursor, n = Cursor(self.revision(tenant)), 0
        while polls is None or n < polls:
            wait()
            found = []
            while page := self.changes(tenant, cursor, metric=metric).collect():
                found, cursor = found + page, next_cursor(page)
            yield [r for r in found if all((r["labels"] or {}).get(k) == v for k, v in (labels or {}).items())]
            n += 1


def change_page(deltas: DataFrame, cursor: Cursor, limit: int = 1000, budget: int | None = MAX_CHANGE_BYTES, metric: str | None = None) -> DataFrame:
    """Current totals of the keys that changed after ``cursor``, in keyset order, up to ``limit`` rows and a byte budget."""
    from pyspark.sql import Window

    limit = limit if 0 < limit <= 1000 else 1000
    if metric is not None:
        deltas = deltas.where(F.col("metric") == metric)
    touched = deltas.where(F.col("revision") >= cursor.revision).select(*KEY).distinct()
    rows = merge(deltas.join(touched, list(KEY), "left_semi"))
    order = ["revision", "metric", "kind", "label_hash", "window_start"]
    at = F.struct(F.lit(cursor.revision).cast("long"), F.lit(cursor.metric), F.lit(cursor.kind), F.lit(cursor.label_hash), F.lit(cursor.window_start).cast("timestamp"))
    after = F.struct(*order) > at if cursor.window_start is not None else F.col("revision") > cursor.revision
    page = rows.where(after).orderBy(*order).limit(limit)
    if budget is None:
        return page
    run = F.sum(cost(page)).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    # The first row always passes: a caller that gets a row over the budget reports it.
    number = F.row_number().over(Window.orderBy(*order))
    return page.withColumns({"_run": run, "_nth": number}).where((F.col("_run") <= budget) | (F.col("_nth") == 1)).drop("_run", "_nth")


def next_cursor(rows: list) -> Cursor | None:
    return Cursor(rows[-1]["revision"], rows[-1]["metric"], rows[-1]["kind"], rows[-1]["label_hash"], rows[-1]["window_start"]) if rows else None


def expired(rollups: DataFrame, now: datetime, days: int = 30) -> DataFrame:
    """Rollups whose window ended strictly before the retention period."""
    return rollups.where(F.col("window_end") < F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days)))
