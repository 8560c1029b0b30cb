"""The interest profile that a corpus is ranked against."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

#: Columns that a dimension would overwrite once it is flattened.
RESERVED = ("overall_fit", "theory_novelty")


@dataclass(frozen=True)
class Dimension:
    key: str
    description: str
    weight: float = 1.0


@dataclass(frozen=True)
class Profile:
    name: str
    description: str = ""
    language: str = "English"
    target_tasks: tuple[str, ...] = ()
    prefer: tuple[str, ...] = ()
    downweight: tuple[str, ...] = ()
    positive_keywords: tuple[str, ...] = ()
    negative_keywords: tuple[str, ...] = ()
    scoring_dimensions: tuple[Dimension, ...] = field(default=())

    def __post_init__(self):
        keys = self.dimension_keys
        if not keys:
            raise ValueError("a profile needs at least one scoring dimension")
        if len(set(keys)) != len(keys):
            raise ValueError("scoring dimensions repeat a key")
        if taken := set(keys) & set(RESERVED):
            raise ValueError(f"scoring dimensions may not be named {sorted(taken)}")

    @property
    def dimension_keys(self) -> tuple[str, ...]:
        return tuple(d.key for d in self.scoring_dimensions)

    @property
    def weights(self) -> dict[str, float]:
        return {d.key: d.weight for d in self.scoring_dimensions}

    def prompt_block(self) -> str:
        """The profile as the judge is told of it."""
        bullets = lambda items, none: "\n".join(f"- {x}" for x in items) or f"- {none}"
        dims = "\n".join(f"- {d.key} (weight {d.weight:g}): {d.description}" for d in self.scoring_dimensions)
        return "\n".join(
            [
                f"Profile: {self.name}",
                f"Direction: {self.description.strip()}",
                "Tasks:",
                bullets(self.target_tasks, "none given"),
                "Favour:",
                bullets(self.prefer, "nothing in particular"),
                "Count against:",
                bullets(self.downweight, "nothing in particular"),
                "Dimensions:",
                dims,
            ]
        )


def _texts(value) -> tuple[str, ...]:
    if value is None or value == "":
        return ()
    return tuple(str(v) for v in (value if isinstance(value, list | tuple) else [value]))


def from_mapping(data: dict, default_name: str = "profile") -> Profile:
    """A profile from decoded YAML; unknown keys are ignored."""
    dims = []
    for d in data.get("scoring_dimensions") or []:
        if isinstance(d, str):
            dims.append(Dimension(d, d))
        else:
            dims.append(Dimension(str(d["key"]), str(d.get("description", d["key"])), float(d.get("weight", 1.0))))
    return Profile(
        name=str(data.get("name") or default_name),
        description=str(data.get("description") or ""),
        language=str(data.get("language") or "English"),
        scoring_dimensions=tuple(dims),
        **{k: _texts(data.get(k)) for k in ("target_tasks", "prefer", "downweight", "positive_keywords", "negative_keywords")},
    )


def load(path: str | Path) -> Profile:
    import yaml

    data = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    if not isinstance(data, dict):
        raise ValueError(f"{path}: a profile is a mapping")
    return from_mapping(data, Path(path).stem)
