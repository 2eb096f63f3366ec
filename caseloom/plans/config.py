"""Configurations of a build and of a training run, checked before anything is read."""

from __future__ import annotations

import re
from collections.abc import Mapping
from pathlib import PurePosixPath

# Parts of field names that may hold a secret, and what a source must name.
SECRET = re.compile(r"token|secret|password|passwd|api_?key|credential|private_key|authorization", re.I)
REQUIRED = ("name", "adapter", "paths", "split", "url", "revision", "license", "source_family", "task_family", "domain")
FRACTIONS = ("calibration_fraction", "validation_fraction", "test_fraction")


class ConfigError(ValueError):
    """A configuration that can't be built."""


def _walk(value, path=""):
    if isinstance(value, Mapping):
        for k, v in value.items():
            yield path, str(k), v
            yield from _walk(v, f"{path}.{k}")
    elif isinstance(value, (list, tuple)):
        for i, v in enumerate(value):
            yield from _walk(v, f"{path}[{i}]")


def check_path(text: str) -> None:
    """A path names something below the configuration's own folder and reads alike on every system: its parts, cut at
    either kind of slash, start with no root or drive and never climb."""
    parts = re.split(r"[/\\]", text) if isinstance(text, str) else [""]
    if parts[0] == "" or ":" in parts[0] or ".." in parts:
        raise ConfigError(f"{text!r} leads out of the configuration's folder")


def check_build(config: Mapping) -> None:
    """Raises :class:`ConfigError` for a build that must not start: another format, no sources, missing or repeated
    names, secrets in fields or URLs, paths that leave the folder, fractions out of range."""
    if config.get("format_version") != 1:
        raise ConfigError("format_version must be 1")
    for _, key, value in _walk(config):
        if SECRET.search(key):
            raise ConfigError(f"{key!r} may hold a secret")
        if isinstance(value, str) and re.search(r"://[^/\s]*@|[?&](?:token|key|sig|signature|access_token)=", value, re.I):
            raise ConfigError(f"{key}: a URL with credentials")
    sources = config.get("sources")
    if not isinstance(sources, list) or not sources:
        raise ConfigError("sources must be a list with entries")
    names = []
    for source in sources:
        missing = [k for k in REQUIRED if source.get(k) in (None, "", [])]
        if missing:
            raise ConfigError(f"source {source.get('name')!r} lacks {', '.join(missing)}")
        names.append(source["name"])
        paths = source["paths"]
        listed = list(paths.values()) if isinstance(paths, Mapping) else [paths] if isinstance(paths, str) else list(paths)
        auxiliary = source.get("auxiliary_paths") or {}
        listed += list(auxiliary.values() if isinstance(auxiliary, Mapping) else auxiliary)
        for p in listed:
            check_path(p)
        bases = [PurePosixPath(p).name for p in listed]
        if len(set(bases)) != len(bases):
            raise ConfigError(f"source {source['name']!r} has two files of one name")
    if len(set(names)) != len(names):
        raise ConfigError("source names must differ")
    held = [float(config.get(f, 0)) for f in FRACTIONS]
    if any(f < 0 for f in held) or sum(held) >= 1:
        raise ConfigError("held-out fractions must be 0 or more and sum to less than 1")
    if config.get("prepartitioned") and any(held):
        raise ConfigError("a prepartitioned build takes no held-out fractions")


# Settings of a training-side run with their kinds and ranges.
RUN_SETTINGS = {
    "seed": (int, 0, None), "max_len": (int, 16, None), "head_max_len": (int, 16, None), "batch_size": (int, 1, None), "max_tokens_per_batch": (int, 1, None), "length_bucketed": (bool, None, None),
    "overflow": (str, None, ("filter", "truncate")), "calibration_split": (str, None, None), "calibration_max_items": (int, 1, None), "eval_splits": (list, None, None), "dataset": (dict, None, None), "dataset_info": (str, None, None),
    "output": (str, None, None), "workers": (int, 1, None), "world": (int, 1, None), "state_side": (str, None, ("right", "left")),
}


def check_run(config: Mapping) -> None:
    """Raises :class:`ConfigError` for an unknown setting, a wrong kind (a boolean is no number), a value out of range,
    or not exactly one of ``dataset`` and ``dataset_info``."""
    for key, value in config.items():
        if key not in RUN_SETTINGS:
            raise ConfigError(f"unknown setting {key!r}")
        kind, low, allowed = RUN_SETTINGS[key]
        if value is None:
            continue
        if not isinstance(value, kind) or kind is int and isinstance(value, bool):
            raise ConfigError(f"{key} must be {kind.__name__}")
        if low is not None and value < low:
            raise ConfigError(f"{key} must be at least {low}")
        if allowed is not None and value not in allowed:
            raise ConfigError(f"{key} must be one of {', '.join(allowed)}")
    if (config.get("dataset") is None) == (config.get("dataset_info") is None):
        raise ConfigError("exactly one of dataset and dataset_info is needed")


def reusable_cache(manifest: Mapping, config: Mapping) -> bool:
    """Whether a token table may be used again: equal head budget and adapter settings; settings that the older
    manifest doesn't name are accepted."""
    if manifest.get("head_max_len") != config.get("head_max_len"):
        return False
    known, wanted = manifest.get("adapter_params"), config.get("adapter_params") or {}
    return known is None or dict(known) == dict(wanted)
