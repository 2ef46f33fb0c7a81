"""A library kept as immutable versions of Parquet tables, with a pointer to the current one.

A version names the folder of each of its tables, so a commit writes the tables that it changes and no others. It writes them beside what is there, checks the new version, and
renames a staged pointer file to the next number: readers take the pointer with the highest number, so they see all of a version or none, and at no time no version. The old
version is the backup, and the digests that its pointer holds verify it.

Several writers may start from one version. A rename that meets a pointer of its number is refused; the writer then looks at what was committed since it began: where none of it is
what it read or wrote, it takes the newer version as its base and tries again, else it fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.digest import content_digest


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._staged: dict[str, dict] = {}
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def pointers(self) -> list[str]:
        folder = self._path(self.path)
        names = [x.getPath().getName() for x in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(n for n in names if n.startswith("CURRENT-"))

    def manifest(self, pointer: str) -> dict:
        """What a pointer says: ``version``, ``tables`` (folders by name), ``written``, ``digests``. A pointer of an older form names its version only."""
        said = json.loads(self.spark.read.text(f"{self.path}/{pointer}", wholetext=True).first().value)
        if "tables" not in said:
            names = sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.path}/{said['version']}")))
            said |= {"tables": {n: f"{said['version']}/{n}" for n in names}, "written": names, "digests": {}}
        return said

    def since(self, version: str | None) -> list[dict]:
        """Manifests from the latest back to that of ``version``, without it."""
        out = []
        for pointer in reversed(self.pointers()):
            said = self.manifest(pointer)
            if said["version"] == version:
                break
            out.append(said)
        return out

    def of(self, version: str | None) -> dict | None:
        """The manifest of a version, by default the current one."""
        if version in self._staged:
            return self._staged[version]
        pointers = self.pointers()
        if version is None:
            return self.manifest(pointers[-1]) if pointers else None
        return next((m for p in reversed(pointers) if (m := self.manifest(p))["version"] == version), None)

    def version(self) -> str | None:
        current = self.of(None)
        return current and current["version"]

    def tables(self, version: str | None = None) -> list[str]:
        said = self.of(version)
        return sorted(said["tables"]) if said else []

    def read(self, table: str, version: str | None = None) -> DataFrame:
        said = self.of(version)
        if said is None or table not in said["tables"]:
            raise ValueError(f"no table {table} in {version or 'the library'}")
        return self.spark.read.parquet(f"{self.path}/{said['tables'][table]}")

    def commit(self, tables: dict[str, DataFrame], base: str | None, check: Callable[[Store, str], None] | None = None, reads: Iterable[str] | None = None) -> str:
        """Write ``tables`` as a new version, check it, and make it current; the other tables are those of the version it follows.

        ``reads`` names the tables that the new ones were made from, by default all: then any commit since ``base`` is a conflict.
        """
        version = f"v-{uuid.uuid4().hex}"
        self.unchanged(base, tables, reads)
        for name, df in tables.items():
            df.write.mode("errorifexists").parquet(f"{self.path}/{version}/{name}")
        own = {name: f"{version}/{name}" for name in tables}
        digests = {name: table_digest(self.spark.read.parquet(f"{self.path}/{folder}")) for name, folder in own.items()}
        while True:
            follows = self.unchanged(base, tables, reads) or {"tables": {}, "digests": {}, "version": None}
            said = {"version": version, "follows": follows["version"], "tables": follows["tables"] | own, "written": sorted(own), "digests": follows["digests"] | digests}
            self._staged[version] = said
            try:
                if check:
                    check(self, version)
            finally:
                del self._staged[version]
            if self.point(said, follows["version"]):
                return version

    def unchanged(self, base: str | None, tables: Iterable[str], reads: Iterable[str] | None) -> dict | None:
        """The manifest to follow: the latest, if nothing committed since ``base`` is among the tables read or written."""
        later = self.since(base)
        mine = None if reads is None else {*tables, *reads}
        if any(mine is None or mine & set(m["written"]) for m in later):
            raise ValueError("the library has changed since it was read")
        return later[0] if later else self.of(base) if base is not None else None

    def point(self, said: dict, follows: str | None) -> bool:
        """Make a version current, unless another has become so."""
        staged = self._path(f"{self.path}/.CURRENT-{said['version']}-{uuid.uuid4().hex}")
        out = self._fs.create(staged, False)
        out.write(bytearray(json.dumps(said).encode()))
        out.close()
        pointers = self.pointers()
        if (self.manifest(pointers[-1])["version"] if pointers else None) == follows:
            number = int(pointers[-1].rsplit("-", 1)[1]) + 1 if pointers else 1
            pointer = self._path(f"{self.path}/CURRENT-{number:012d}")
            if not self._fs.exists(pointer) and self._fs.rename(staged, pointer):
                return True
        self._fs.delete(staged, False)
        return False

    def verify(self, version: str | None = None) -> None:
        """Compare every table of a version, such as a backup, with the digest that its commit took."""
        said = self.of(version)
        bad = [n for n, d in (said["digests"] if said else {}).items() if table_digest(self.read(n, version)) != d]
        if bad:
            raise ValueError(f"tables differ from what was committed: {', '.join(sorted(bad))}")

    def digest(self, version: str | None = None, drop: dict[str, tuple[str, ...]] | None = None) -> str:
        """One digest of all tables of a version: sums of row digests, so no table is ordered or collected."""
        parts = {}
        for name in self.tables(version):
            df = self.read(name, version)
            df = df.select(*sorted(c for c in df.columns if c not in (drop or {}).get(name, ())))
            parts[name] = [df.schema.simpleString(), *row_digest(df)]
        return content_digest(parts)


def table_digest(df: DataFrame) -> list[str]:
    df = df.select(*sorted(df.columns))
    return [df.schema.simpleString(), *row_digest(df)]


def row_digest(df: DataFrame) -> list[str]:
    """Number of rows, and sums of four 60-bit parts of the rows' SHA-256: the same for any order of rows."""
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"p{k}") for k in range(4)]
    return [str(x) for x in df.agg(F.count(F.lit(1)).alias("n"), *parts).first()]
