"""Session helpers: run parameters, identifiers, and the shared scratch folder."""

from __future__ import annotations

import gc
import io
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator, Mapping
from contextlib import AbstractContextManager, contextmanager
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from scoreloom.sources.storage import delete_folder, write_file

# The defaults every run starts from.
DEFAULT_PARTITIONS = 128
DEFAULT_MICRO_BATCH = 8
DEFAULT_MODEL_BATCH = 64
DEFAULT_WRITERS = 32


@dataclass(frozen=True)
class RunParams:
    """Parameters of one run. All arrive as text and are cast once, here."""

    catalog: str
    schema: str
    dataset: str
    image_dir: str
    image_glob: str = "*"  # relative to image_dir, fixes the depth
    file_glob: str = "*"  # on the file name, at any depth
    model_name: str = "classifier"
    model_alias: str = "prod"
    n_images: int | None = None  # the first so many by path; None: all
    num_partitions: int | None = DEFAULT_PARTITIONS  # at least; None: by the bytes to read
    write_workers: int = DEFAULT_WRITERS
    micro_batch: int = DEFAULT_MICRO_BATCH

    @classmethod
    def from_text(cls, values: Mapping[str, str]) -> RunParams:
        """Cast text parameters; a bad number raises, empty ``n_images`` means all files."""
        casts = {"write_workers": int, "micro_batch": int}
        out: dict = {}
        for key, text in values.items():
            if key not in cls.__dataclass_fields__:
                raise ValueError(f"unknown parameter: {key}")
            if key in ("n_images", "num_partitions"):
                out[key] = int(text) if text.strip() else None
            else:
                out[key] = casts.get(key, str)(text)
        return cls(**out)

    @property
    def model_uri(self) -> str:
        return f"models:/{self.model_name}@{self.model_alias}"


def parse_switch(text: str) -> bool:
    """A two-value dropdown: exactly ``true`` or ``false``."""
    if text not in ("true", "false"):
        raise ValueError(f"expected 'true' or 'false', got {text!r}")
    return text == "true"


def quote_name(*parts: str) -> str:
    """Dotted identifier with every part quoted; empty parts are left out."""
    return ".".join("`" + p.replace("`", "``") + "`" for p in parts if p)


def output_table(params: RunParams, pattern: str, kind: str) -> str:
    """Table name of one pattern's output for one dataset, e.g. ``bench_p3_coco_predictions``."""
    # Fixed format of the table names.
    stem = "_".join(x for x in ("bench", pattern, params.dataset, kind) if x)
    return quote_name(params.catalog, params.schema, stem)


def make_namespace(spark: SparkSession, schema: str, location: str | None = None, catalog: str = "") -> None:
    """Create the output schema when it is missing, in ``catalog`` or else in the current one."""
    where = "" if location is None else " LOCATION '" + location.replace("'", "\\'") + "'"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {quote_name(catalog, schema)}{where}")


@contextmanager
def session_conf(spark: SparkSession, values: Mapping[str, object]) -> Iterator[None]:
    """Set configuration for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    for key, value in values.items():
        spark.conf.set(key, str(value))
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def payload_batches(spark: SparkSession, rows: int) -> AbstractContextManager[None]:
    """Hand payloads to Python a few at a time: Spark counts rows per batch, not bytes."""
    return session_conf(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": rows})


_OWN_SCRATCH: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own; on a cluster such a
    folder would be invisible to the other machines, so there the setting is required.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):  # one process; local-cluster is several
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        app = spark.sparkContext.applicationId
        if app not in _OWN_SCRATCH:
            _OWN_SCRATCH[app] = tempfile.mkdtemp(prefix="scoreloom-")
        root = _OWN_SCRATCH[app]
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str, unique: bool = True) -> str:
    """A folder of this application's own below the scratch root."""
    app = re.sub(r"[^A-Za-z0-9_-]", "_", spark.sparkContext.applicationId)
    tail = f"{name}-{uuid.uuid4().hex[:12]}" if unique else name
    return f"{scratch_root(spark)}/scoreloom/{app}/{tail}"


def shared_uri(spark: SparkSession, folder: str) -> str:
    """``folder`` with its file-system scheme, so that Python tasks open the place Spark means."""
    if re.match(r"^[a-z][a-z0-9+.-]*:", folder):
        return folder
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    return default.rstrip("/") + folder if not default.startswith("file:") else "file://" + folder


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application.

    Not needed where it is installed on every machine; harmless there.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    home = Path(__file__).parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(home.rglob("*.py")):
            archive.write(source, source.relative_to(home.parent))
    target = shared_uri(spark, scratch_path(spark, "code") + "/scoreloom.zip")
    write_file(target, packed.getvalue())
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the scratch folder and read it back.

    Used where one result feeds several readers that must see the same values (sampled ranges, sums of
    doubles), and to cut lineage in a way that survives the loss of executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._written_to = path  # type: ignore[attr-defined]
    return written


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Give back a folder of this application's scratch space that no later step reads."""
    if not path.startswith(scratch_path(spark, "", unique=False)):
        raise ValueError(f"{path} is no scratch folder of this application")
    delete_folder(shared_uri(spark, path))


def drop_written(*tables: DataFrame) -> None:
    """The same for tables that ``materialise`` wrote, once what was made of them is written too."""
    for df in tables:
        drop_scratch(df.sparkSession, df._written_to)  # type: ignore[attr-defined]


def drop_shuffles(spark: SparkSession) -> None:
    """Have the driver let go of steps that are done: Spark deletes their shuffle files only once it collects its garbage, and
    those of the last job only after another one."""
    gc.collect()
    spark.range(0, 1, 1, 1).collect()
    spark.sparkContext._jvm.System.gc()
