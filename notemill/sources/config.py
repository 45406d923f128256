"""Settings of the engine and of vaults: YAML files over defaults."""

from __future__ import annotations

import copy
import os
import re
from pathlib import Path
from typing import Any

#: The defaults of all settings.
DEFAULTS: dict[str, Any] = {
    "indexing": {"chunk_size": 1000, "max_file_size": 10_485_760, "debounce_ms": 1000, "batch_size": 50},
    "search": {
        "max_results": 100,
        "similarity_threshold": 0.7,
        "ranking_weights": {"semantic": 0.4, "tags": 0.3, "recency": 0.2, "backlinks": 0.1},
    },
    "links": {"patterns": [r"\[\[([^\]]+)\]\]", r"\[([^\]]+)\]\(([^\)]+\.md)\)"]},
    "tags": {"inline": r"#([a-zA-Z0-9_/-]+)", "frontmatter": ["tags"]},
    "validation": {"rules": []},
    "templates": [],
}


def merged(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """``over`` laid over ``base``, section by section; lists and scalars replace."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


# The kinds and bounds of the settings, by their place; ``*`` stands for each entry of a list or mapping.
_NUMBER, _WHOLE, _TEXT, _LIST = (int, float), int, str, list
_KINDS: dict[str, tuple] = {
    "name": (_TEXT,), "path": (_TEXT,),
    "indexing.chunk_size": (_WHOLE, 1), "indexing.max_file_size": (_WHOLE, 1), "indexing.debounce_ms": (_WHOLE, 100), "indexing.batch_size": (_WHOLE, 1),
    "embeddings.provider": (_TEXT,), "embeddings.model": (_TEXT,), "embeddings.api_key": (_TEXT,),
    "search.max_results": (_WHOLE, 1), "search.similarity_threshold": (_NUMBER, 0, 1), "search.ranking_weights.*": (_NUMBER, 0, 1),
    "links.patterns": (_LIST,), "links.patterns.*": (_TEXT,), "tags.inline": (_TEXT,), "tags.frontmatter": (_LIST,), "tags.frontmatter.*": (_TEXT,),
    "frontmatter.date_format": (_TEXT,), "frontmatter.required_fields": (_LIST,), "frontmatter.required_fields.*": (_TEXT,),
    "templates": (_LIST,), "templates.*.pattern": (_TEXT,), "templates.*.required": (_LIST,), "templates.*.required.*": (_TEXT,), "templates.*.schema": (dict,), "templates.*.content": (_TEXT,),
    "validation.rules": (_LIST,), "validation.rules.*.name": (_TEXT,), "validation.rules.*.pattern": (_TEXT,), "validation.rules.*.script": (_TEXT,), "validation.rules.*.on": (_LIST,), "validation.rules.*.on.*": (_TEXT,),
}
_NEEDED = {"templates.*": ("pattern",), "validation.rules.*": ("name", "pattern")}


def problems(settings: dict[str, Any]) -> list[str]:
    """What is wrong with the settings, one line each; sections that this engine does not know are left alone."""
    out: list[str] = []

    def look(value: Any, at: str, rule: str) -> None:
        kind, *bounds = _KINDS.get(rule, (object,))
        if not isinstance(value, kind) or (isinstance(value, bool) and kind is not object):
            names = " or ".join(k.__name__ for k in (kind if isinstance(kind, tuple) else (kind,)))
            out.append(f"{at} must be of type {names}")
            return
        if bounds and (value < bounds[0] or (len(bounds) > 1 and value > bounds[1])):
            out.append(f"{at} must lie in {bounds[0]}..{bounds[1] if len(bounds) > 1 else ''}")
        out.extend(f"{at}.{k} is missing" for k in _NEEDED.get(rule, ()) if not isinstance(value, dict) or k not in value)
        entries = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
        for k, v in entries:
            own = f"{rule}.{k}" if rule else str(k)
            look(v, f"{at}.{k}" if at else str(k), own if own in _KINDS or isinstance(value, dict) and not any(x.startswith(f"{rule}.*") for x in _KINDS) else f"{rule}.*")

    look(settings, "", "")
    return out


def checked(settings: dict[str, Any]) -> dict[str, Any]:
    """The settings, or ValueError naming all that is wrong."""
    wrong = problems(settings)
    if wrong:
        raise ValueError("; ".join(wrong))
    return settings


def skeleton(folder: str, vault_path: str) -> list[str]:
    """Lay down a vault: a settings file of its own and a welcome note, where there are none; the paths that were written."""
    import yaml

    name = Path(vault_path).name
    texts = {
        Path(folder, "vaults", f"{name}.yaml"): yaml.safe_dump({"name": name, "path": vault_path}, sort_keys=False),
        Path(vault_path, "Welcome.md"): f"---\ntitle: Welcome\ntags: [welcome]\n---\n# Welcome to {name}\n\nLink notes with [[double brackets]] and tag them with #tags.\n",
    }
    made = [p for p in texts if not p.exists()]
    for p in made:
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(texts[p], encoding="utf-8")
    return [str(p) for p in made]


def global_config(folder: str) -> dict[str, Any]:
    """``settings.yaml`` of a folder over the defaults; the defaults where there is none."""
    path = Path(folder, "settings.yaml")
    return checked(merged(DEFAULTS, _yaml(path)) if path.exists() else copy.deepcopy(DEFAULTS))


def vault_config(folder: str, vault_path: str, settings: dict[str, Any] | None = None) -> dict[str, Any]:
    """``vaults/<name>.yaml`` over the global settings; without it just name and path."""
    name = Path(vault_path).name
    path = Path(folder, "vaults", f"{name}.yaml")
    own = _yaml(path) if path.exists() else {}
    return checked(merged(settings or global_config(folder), {"name": name, "path": vault_path} | own))


def _yaml(path: Path) -> dict[str, Any]:
    import yaml

    data = yaml.safe_load(path.read_text(encoding="utf-8"))
    if data is None:
        return {}
    if not isinstance(data, dict):
        raise ValueError(f"{path} holds no mapping")
    return data


def with_environment(text: str) -> str:
    """``${NAME}`` replaced from the environment; unknown names become empty."""
    return re.sub(r"\$\{([^}]+)\}", lambda m: os.environ.get(m.group(1), ""), text)
