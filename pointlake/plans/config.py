"""Configuration files: nested mappings, merged by layer."""

from __future__ import annotations

from pathlib import Path


def merge(base: dict, over: dict) -> dict:
    """``over`` on top of ``base``, mapping by mapping."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def read_yaml(path: str | Path) -> dict:
    import yaml

    got = yaml.safe_load(Path(path).read_text()) or {}
    if not isinstance(got, dict):
        raise ValueError(f"{path} is no mapping")
    return got


def load(folder: str | Path | None = None, task: str | None = None, path: str | Path | None = None) -> dict:
    """An explicit file alone, or base.yaml with <task>.yaml on top; local.yaml in the folder comes last."""
    if path:
        config = read_yaml(path)
    else:
        config = read_yaml(Path(folder) / "base.yaml")
        if task:
            config = merge(config, read_yaml(Path(folder) / f"{task}.yaml"))
    local = Path(folder) / "local.yaml" if folder else None
    return merge(config, read_yaml(local)) if local and local.exists() else config
