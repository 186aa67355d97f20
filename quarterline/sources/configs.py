"""Feature sets and paths from plain configuration dictionaries."""

from __future__ import annotations

import ast


def collect(sets: dict[str, dict], name: str, section: str, _open: tuple[str, ...] = ()) -> list[str]:
    """The columns of a section, those of included sets first, each once; a set that includes itself is an error."""
    if name in _open:
        raise ValueError(f"{' -> '.join((*_open, name))}: a set includes itself")
    if name not in sets:
        raise KeyError(f"no feature set {name}")
    found = [c for part in sets[name].get("include_sets") or () for c in collect(sets, part, section, (*_open, name))]
    return list(dict.fromkeys([*found, *(sets[name].get(section) or ())]))


def targets(wanted: str | list[str], features: list[str]) -> list[str]:
    """All features, or the wanted ones; one that is no feature is an error."""
    chosen = list(features) if wanted == "all" else as_list(wanted)
    if missing := [t for t in chosen if t not in features]:
        raise ValueError(f"not among the features: {', '.join(missing)}")
    return chosen


def year_to_date(names: list[str]) -> list[str]:
    """Names of year-to-date items as those of the quarter: a y at the end becomes a q."""
    return [n[:-1] + "q" if n.endswith("y") else n for n in names]


def as_list(value) -> list:
    """A list, a text that looks like one, or text with commas."""
    if isinstance(value, (list, tuple)):
        return list(value)
    text = str(value).strip()
    if text.startswith("["):
        return list(ast.literal_eval(text))
    return [x.strip() for x in text.split(",") if x.strip()]


def dataset_path(folder: str, kind: str, features: str, tag: str | None = None, exists=lambda path: True, ext: str = "parquet") -> str:
    """The tagged name if it is there, else the one without a tag."""
    tagged = f"{folder}/{kind}_{features}" + (f"_{tag}" if tag else "") + f".{ext}"
    return tagged if not tag or exists(tagged) else f"{folder}/{kind}_{features}.{ext}"


def output_tag(*parts: object) -> str:
    """Parts joined for a file name, empty ones left out, other characters than letters and digits folded."""
    return "__".join("".join(c if c.isalnum() else "_" for c in str(p)).strip("_") for p in parts if p not in (None, ""))


def horizon_at(epoch: int, start: int, step: int, every: int, furthest: int) -> int:
    """Horizon of a curriculum that grows by step every so many epochs."""
    return min(furthest, start + step * (epoch // max(1, every)))


def guard_resume(have: dict, want: dict) -> None:
    """Outputs made with other settings must not be continued."""
    if changed := sorted(k for k in want if k in have and have[k] != want[k]):
        raise ValueError(f"made with other settings: {', '.join(f'{k} ({have[k]!r}, now {want[k]!r})' for k in changed)}")
