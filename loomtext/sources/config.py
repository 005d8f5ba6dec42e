"""Configuration documents, QA rules, lexicon files."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.operators.summary import RULES


def load_config(spark: SparkSession, path: str) -> dict:
    """A JSON or YAML document by its ending; YAML needs PyYAML."""
    text = spark.read.text(path, wholetext=True).first()[0]
    if not path.lower().endswith((".yaml", ".yml")):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML documents need PyYAML") from e
    return yaml.safe_load(text)


def _names(value) -> list[str]:
    """A list, or a comma-separated text, as names."""
    parts = value.split(",") if isinstance(value, str) else list(value or ())
    return [str(x).strip() for x in parts if str(x).strip()]


def qa_rules(spark: SparkSession, config: dict | list) -> DataFrame:
    """Rules of a list, of ``rules``, or of ``qa.rules``, in order; a rule without a pattern is an error."""
    if isinstance(config, dict):
        config = (config.get("qa") or {}).get("rules", config.get("rules"))
    if not isinstance(config, list) or not all(isinstance(r, dict) for r in config):
        raise ValueError("QA rules must be a list of objects, or stand under rules or qa.rules")
    rows = []
    for i, r in enumerate(config):
        pattern = str(r.get("pattern") or "").strip()
        if not pattern:
            raise ValueError(f"QA rule {i} has no pattern")
        most = r.get("max_tokens")
        rows.append((i, str(r.get("name") or f"rule_{i + 1}"), pattern, _names(r.get("require_categories")), _names(r.get("require_raw_types")), None if most is None else int(most)))
    return spark.createDataFrame(rows, RULES)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(name): distinct names of a file of one name a line; blank lines and comments are skipped."""
    names = spark.read.text(path).select(F.trim("value").alias("name"))
    return names.where("name <> '' and not startswith(name, '#')").distinct()


#: Folders that a curated root holds, and the settings that may name it; fixed values.
ROOT_FOLDERS, ROOT_KEYS = ("curation_data", "source_articles"), ("curated_root", "curated_data_root")


def resolve_root(spark: SparkSession, settings: dict, *, variables: tuple[str, ...] = (), default: str | None = None) -> tuple[str, dict]:
    """(path, where it comes from) of the curated data: a setting, an environment variable, or a default folder if it's there.

    The first that is given counts, and must hold the folders of curated data; any
    file system of Spark will do. Nothing is downloaded.
    """

    def holds(path: str, *names: str) -> bool:
        own = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = own.getFileSystem(spark._jsc.hadoopConfiguration())
        return all(fs.isDirectory(spark._jvm.org.apache.hadoop.fs.Path(own, n)) for n in names) if names else fs.exists(own)

    given = [({"source": "config", "key": k}, settings.get(k)) for k in ROOT_KEYS]
    given += [({"source": "env", "env": v}, os.environ.get(v)) for v in variables]
    given += [({"source": "local"}, default if default and holds(default) else None)]
    for info, path in given:
        if path:
            path = os.path.expanduser(str(path))
            if not holds(path, *ROOT_FOLDERS):
                raise ValueError(f"no curated data at {path}")
            return path, info | {"path": path}
    raise ValueError("no curated root is given, and none is downloaded")
