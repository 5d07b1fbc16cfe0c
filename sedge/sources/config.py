"""Configuration, history and table files."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.text import newest

try:
    import yaml
except ImportError:
    yaml = None

HISTORY = "id string, project string, build_type string, status string, started_at timestamp_ntz, message string"


def load_config(path: str) -> dict:
    """The mapping of a YAML file, nested as it stands; an empty file gives none, other content is an error.

    Without a YAML library only flat `key: value` lines are read, and indented ones are refused.
    """
    text = Path(path).read_text(encoding="utf-8")
    if yaml is None:
        return _flat(text)
    try:
        found = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ValueError(f"not YAML: {path}") from e
    if found is None:
        return {}
    if not isinstance(found, dict):
        raise ValueError(f"not a mapping: {path}")
    return found


def save_config(config: dict, path: str) -> None:
    """Write a mapping so that load_config gives it again, keys in their order; folders are made."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    if yaml is None:
        raise RuntimeError("saving needs a YAML library")
    Path(path).write_text(yaml.safe_dump(config, sort_keys=False, allow_unicode=True, width=1 << 20), encoding="utf-8")


def _flat(text: str) -> dict:
    out: dict[str, str] = {}
    for line in text.splitlines():
        plain = line.split("#", 1)[0].rstrip()
        if not plain.strip():
            continue
        key, mark, value = plain.partition(":")
        if not mark or not key.strip() or key[0].isspace() or key.startswith("-"):
            raise ValueError(f"not a key and value: {plain!r}")
        out[key.strip()] = value.strip().strip("\"'")
    return out


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Build history; without files it is empty."""
    try:
        return spark.read.schema(HISTORY).json(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], HISTORY)
        raise


def append_history(history: DataFrame, records: DataFrame, most: int = 50) -> DataFrame:
    """The next snapshot of a history: the newest records of each project, up to a number."""
    return newest(history.unionByName(records), "project", "started_at", most, "id").drop("place")


def export_tables(spark: SparkSession, path: str) -> DataFrame:
    """Tables of a JSON file: tableName, headers and values."""
    return spark.read.schema("tableName string, headers array<string>, values array<string>").json(path, multiLine=True).where(F.col("tableName").isNotNull())


def write_history(history: DataFrame, path: str) -> None:
    """A history snapshot that read_history reads."""
    history.select(*[c.split()[0] for c in HISTORY.split(", ")]).write.mode("overwrite").json(path)
