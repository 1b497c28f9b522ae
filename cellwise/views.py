"""Results as views, so that SQL can be asked of them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession


def register(spark: SparkSession, sf_dir: str, names: Iterable[str] | None = None, tables: bool = True) -> list[str]:
    """Registers the queries ``names`` (all of the core, if none are given) over the tables in ``sf_dir`` as temporary views of their names, with the tables themselves.

    Views are lazy, but for queries that write intermediate tables when their plan is built. Returns the views' names.
    """
    from cellwise.plans import catalog
    from cellwise.session import table

    done = []
    if tables:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sf_dir)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
        for name in sorted(f.getPath().getName()[:-8] for f in files if f.getPath().getName().endswith(".parquet")):
            table(spark, sf_dir, name).createOrReplaceTempView(name)
            done.append(name)
    for name in catalog.QUERIES if names is None else names:
        catalog.QUERIES[name](spark, sf_dir).createOrReplaceTempView(name)
        done.append(name)
    return done
