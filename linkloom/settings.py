"""Settings of a run on the driver: their check, the choice of a file and of a provider, and files that were written.

Fixed values: messages, sections, levels and kinds of databases, as they are part of the results.
"""

from __future__ import annotations

import json
import logging
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)

SECTIONS = ("app", "logging", "database", "processing")
APP_FIELDS = ("name", "version", "environment")
LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")
DATABASES = ("sqlite", "postgresql", "mysql")
COUNTS = ("batch_size", "max_workers", "checkpoint_interval")
#: The models that each provider is known to have.
MODELS = {
    "claude": ("claude-3-5-sonnet-20241022", "claude-3-opus-20240229", "claude-3-sonnet-20240229", "claude-3-haiku-20240307"),
    "grok": ("grok-beta", "grok-vision-beta"),
    "gemini": ("gemini-1.5-pro", "gemini-1.5-flash", "gemini-1.0-pro", "gemini-1.0-pro-vision"),
}


def check_settings(settings: object) -> dict:
    """{is_valid, errors, warnings, metadata} of settings as read from a file."""
    if not isinstance(settings, dict):
        return {"is_valid": False, "errors": ["Configuration must be a dictionary"], "warnings": [], "metadata": {}}
    errors = [f"Missing required configuration section: {s}" for s in SECTIONS if s not in settings]
    for section in (s for s in SECTIONS if s in settings):
        own = settings[section]
        if not isinstance(own, dict):
            errors.append(f"{section.capitalize()} configuration must be a dictionary")
        elif section == "app":
            errors += [f"Missing app configuration field: {f}" for f in APP_FIELDS if f not in own]
        elif section == "logging" and own.get("level", LEVELS[0]) not in LEVELS:
            errors.append(f"Invalid logging level: {own['level']}")
        elif section == "database" and own.get("type", DATABASES[0]) not in DATABASES:
            errors.append(f"Invalid database type: {own['type']}")
        elif section == "processing":
            errors += [f"Processing {f} must be a positive integer" for f in COUNTS if f in own and not (isinstance(own[f], int) and own[f] > 0)]
    return {"is_valid": not errors, "errors": errors, "warnings": [], "metadata": {"section_count": len(settings)}}


def check_path(path: object, must_exist: bool = False, extensions: list[str] | None = None) -> dict:
    """{is_valid, errors, warnings, metadata} of a path on the driver's disk."""
    if not isinstance(path, str) or not path:
        return {"is_valid": False, "errors": ["File path must be a non-empty string"], "warnings": [], "metadata": {}}
    p = Path(path)
    there, suffix = p.exists(), p.suffix.lower()
    errors = [f"File does not exist: {path}"] * (must_exist and not there)
    errors += [f"File extension not allowed. Expected: {extensions}"] * bool(extensions and suffix not in extensions)
    meta = {"absolute_path": str(p.absolute()), "exists": there, "is_file": p.is_file() if there else None, "is_dir": p.is_dir() if there else None, "extension": suffix}
    return {"is_valid": not errors, "errors": errors, "warnings": ["Path points to a directory, not a file"] * (there and p.is_dir()), "metadata": meta}


def read_settings(folder: str, environment: str | None = None) -> dict:
    """The settings of an environment (ENVIRONMENT, else development): its .yaml where a YAML reader is installed, or its
    .json. Where there is none, or it can't be read, that is logged and the settings are empty: all defaults hold."""
    name = environment or os.environ.get("ENVIRONMENT", "development")
    for suffix, read in ((".yaml", _yaml), (".json", json.loads)):
        path = Path(folder, name + suffix)
        if path.exists():
            try:
                return read(path.read_text(encoding="utf-8")) or {}
            except Exception:  # noqa: BLE001 - a broken file means defaults
                log.exception("could not read %s", path)
    log.warning("no settings of %s in %s", name, folder)
    return {}


def _yaml(text: str) -> dict:
    import yaml

    return yaml.safe_load(text)


def choose_provider(available: list[str], preferred: str | None = None, default: str | None = None) -> str:
    """The preferred provider if it is available, else the default one, else the first; ValueError for none."""
    found = next((p for p in (preferred, default, *available) if p in available), None)
    if found is None:
        raise ValueError("no provider is available")
    return found


def model_info(provider: str, settings: dict) -> dict:
    """A provider's model with its limits, and whether it is one of the known."""
    model = settings.get("model") or MODELS[provider][0]
    return {"provider": provider, "model": model, "known": model in MODELS[provider], "max_tokens": settings.get("max_tokens", 4096), "temperature": settings.get("temperature", 0.7), "has_key": bool(settings.get("api_key"))}


def listed_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modified, size_bytes) of all files below a folder, in any file system that Spark reads; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.selectExpr("path", "modificationTime AS modified", "length AS size_bytes").orderBy("path")


def log_statistics(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One row: size of a log file, number and size of its rotated backups (name.1, name.2 and so on)."""
    files = listed_files(spark, folder).selectExpr("element_at(split(path, '/'), -1) AS file", "size_bytes")
    own, backup = f"file = '{name}'", f"startswith(file, '{name}.')"
    return files.selectExpr(f"coalesce(sum(IF({own}, size_bytes, 0)), 0) AS size_bytes", f"count_if({backup}) AS backups", f"coalesce(sum(IF({backup}, size_bytes, 0)), 0) AS backup_bytes") if files.head() else spark.sql("SELECT 0L AS size_bytes, 0L AS backups, 0L AS backup_bytes")
