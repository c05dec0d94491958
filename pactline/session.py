"""Session settings the operators rely on, and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime SQL settings that change results, not only speed.
RESULT_SETTINGS = {
    # A JSON object with a repeated key keeps the last value instead of failing to parse.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# Hides hex literals of 64 bytes (derived key pads) in plan strings.
REDACTION = "spark.sql.redaction.string.regex"
KEY_PADS = "(?i:(0x|x')[0-9a-f]{128}'?)"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators need to a session the caller already owns.

    A redaction pattern of the caller is kept and extended.
    """
    for key, value in RESULT_SETTINGS.items():
        spark.conf.set(key, value)
    own = spark.conf.get(REDACTION, None)
    if not own:
        spark.conf.set(REDACTION, KEY_PADS)
    elif KEY_PADS not in own:
        spark.conf.set(REDACTION, f"(?:{own})|{KEY_PADS}")
    return spark


def local_session(app: str = "pactline", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    cores = None if cpus == "*" else int(cpus)
    settings = {
        "spark.sql.shuffle.partitions": str(cores or 8),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "16g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the cluster's setting, or a local one in tests.

    A machine-local folder is used only with a local master; on a cluster a missing setting is an
    error, because executors would write files that the others cannot read.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if root is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="pactline-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def _scratch_root(spark: SparkSession) -> str:
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/pactline/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in this application's part of the shared checkpoint folder."""
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove all scratch tables of this application, once no DataFrame needs them any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
