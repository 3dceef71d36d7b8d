"""The folder that driver and executors share, for cutting lineage."""

import tempfile


def folder(spark):
    """The folder of `spark.checkpoint.dir`. Only where that is unset, as in tests, a local one is made."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def saved(df, rows=None):
    """The frame, computed once and kept in the shared folder; Spark removes the files when nothing uses them.

    With `rows`, partitions are read together until they hold about that many rows, as a small frame of many partitions would
    make many map tasks, and as many files, in every shuffle that follows. The driver also drops what it no longer refers to: only
    then does Spark delete the shuffle files behind earlier frames that are kept like this one.
    """
    context = df.sparkSession.sparkContext
    folder(df.sparkSession)
    out = df.checkpoint()
    if rows:
        out = out.coalesce(max(1, -(-out.count() // rows)))
        context._jvm.System.gc()
    return out
