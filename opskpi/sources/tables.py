"""The ``Tables`` container: relation name -> DataFrame.

Metrics never read files themselves; they ask a ``Tables`` for a relation by
name.  The same metric code therefore runs on Parquet (tests, bench, a data
lake), on JDBC tables of the ERP database, or on in-memory fixtures.

Names are matched case-insensitively (the source database spells the part
master both ``AllItems`` and ``allItems``).
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterable, Mapping
from threading import RLock

from pyspark.sql import DataFrame, SparkSession


MAX_KEPT_PLANS = 1024   # built plans kept with a Tables; only plans, never data


class Tables:
    """Lazy, case-insensitive mapping of relation names to DataFrames.

    It also keeps the plans built on it (``plan``), so they live exactly as
    long as the relations they read; ``fresh`` starts over with the same
    loaders (new file listings, no plans).  Safe to share between threads.
    """

    def __init__(self, loaders: Mapping[str, Callable[[], DataFrame]]):
        self._loaders = {k.lower(): v for k, v in loaders.items()}
        self._names = {k.lower(): k for k in loaders}
        self._cache: dict[str, DataFrame] = {}
        self._plans: OrderedDict[tuple, DataFrame] = OrderedDict()
        self._lock = RLock()

    def plan(self, key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
        """The plan built for ``key``, built now if it is not kept."""
        with self._lock:
            if key not in self._plans:
                self._plans[key] = build()
                while len(self._plans) > MAX_KEPT_PLANS:
                    self._plans.popitem(last=False)
            self._plans.move_to_end(key)
            return self._plans[key]

    def fresh(self) -> "Tables":
        return Tables({self._names[k]: v for k, v in self._loaders.items()})

    def __getitem__(self, name: str) -> DataFrame:
        key = name.lower()
        if key not in self._loaders:
            raise KeyError(f"relation {name!r} is not registered")
        with self._lock:
            if key not in self._cache:
                self._cache[key] = self._loaders[key]()
            return self._cache[key]

    def __contains__(self, name: str) -> bool:
        return name.lower() in self._loaders

    def names(self) -> list[str]:
        return sorted(self._names.values())

    # -- constructors -------------------------------------------------------
    @classmethod
    def from_frames(cls, frames: Mapping[str, DataFrame]) -> "Tables":
        return cls({k: (lambda df=v: df) for k, v in frames.items()})

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str,
                     names: Iterable[str]) -> "Tables":
        """One Parquet dataset per relation under ``root/<name>``.

        Accepts both ``<name>.parquet`` files/folders and bare ``<name>``
        folders (partitioned datasets written by Spark).
        """
        def loader(name: str) -> Callable[[], DataFrame]:
            def load() -> DataFrame:
                # asked through Hadoop, so object stores and HDFS work like local folders
                base = root.rstrip("/")
                path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}.parquet")
                there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
                return spark.read.parquet(f"{base}/{name}.parquet" if there else f"{base}/{name}")
            return load

        return cls({n: loader(n) for n in names})

    @classmethod
    def from_paths(cls, spark: SparkSession, paths: Mapping[str, str]) -> "Tables":
        """Relation name -> explicit Parquet path (datasets kept in different places)."""
        return cls({n: (lambda p=p: spark.read.parquet(p)) for n, p in paths.items()})

    @classmethod
    def from_catalog(cls, spark: SparkSession, names: Iterable[str], database: str | None = None) -> "Tables":
        """Relations registered in the session catalogue (``spark.table``).

        Use this for bucketed tables: bucket metadata lives in the catalogue,
        and only catalogue reads let joins on the bucket key skip the shuffle.
        """
        def loader(name: str) -> Callable[[], DataFrame]:
            qualified = f"{database}.{name}" if database else name
            return lambda: spark.table(qualified)

        return cls({n: loader(n) for n in names})

    @classmethod
    def from_jdbc(cls, spark: SparkSession, reader_options: Mapping[str, Mapping[str, str]]) -> "Tables":
        """Relations read through ``spark.read.format('jdbc')``.

        ``reader_options`` maps relation name -> full option dict, see
        :mod:`opskpi.sources.jdbc`.
        """
        def loader(opts: Mapping[str, str]) -> Callable[[], DataFrame]:
            return lambda: spark.read.format("jdbc").options(**opts).load()

        return cls({n: loader(o) for n, o in reader_options.items()})

    def with_frames(self, frames: Mapping[str, DataFrame]) -> "Tables":
        merged: dict[str, Callable[[], DataFrame]] = {
            self._names[k]: v for k, v in self._loaders.items()}
        merged.update({k: (lambda df=v: df) for k, v in frames.items()})
        return Tables(merged)
