"""Parameters: defaults, files with environment variables, merging and precedence. Driver side only."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any


@dataclass
class Calibration:
    use_darks: bool = True
    use_flats: bool = False
    use_bias: bool = False


@dataclass
class Registration:
    method: str = "fft"
    max_rotation_deg: float = 2.0
    max_scale_dev: float = 0.02
    zero_shift_below: float = 0.05
    high_pass: float = 30.0


@dataclass
class Debayer:
    method: str = "superpixel"
    pattern: str = "RGGB"


@dataclass
class Gradient:
    enabled: bool = False
    degree: int = 2
    cells: int = 16
    sigma: float = 3.0


@dataclass
class Cosmetic:
    enabled: bool = False
    n_frames: int = 3
    threshold: float = 50.0
    dark_tolerance: float = 20.0


@dataclass
class Selection:
    enabled: bool = False
    keep_percent: float = 92.0
    min_frames: int = 3
    min_correlation: float | None = 0.05
    bounds: dict = field(default_factory=dict)


@dataclass
class Stacking:
    method: str = "winsorized"
    normalise: str = "mul"


@dataclass
class Merge:
    method: str = "weighted_average"
    weight: str = "frame_count"
    reference: str = "quality"
    min_correlation: float = 0.1


@dataclass
class Colour:
    enabled: bool = False
    sources: list = field(default_factory=lambda: ["catalog"])
    radius_arcsec: float = 3.0
    min_stars: int = 5
    low: float = 0.5
    high: float = 2.0
    fallback: str = "gray_world"


@dataclass
class Drizzle:
    enabled: bool = False
    scale: float = 2.0
    pixfrac: float | None = None
    kernel: str = "point"
    min_frames: int = 5
    gate: bool = True
    min_stars: int = 3


@dataclass
class Display:
    stretch: str = "asinh"
    a: float = 0.01
    saturation: float = 1.0
    scnr: float = 0.5
    neutralise: bool = True


@dataclass
class Params:
    calibration: Calibration = field(default_factory=Calibration)
    debayer: Debayer = field(default_factory=Debayer)
    registration: Registration = field(default_factory=Registration)
    gradient: Gradient = field(default_factory=Gradient)
    cosmetic: Cosmetic = field(default_factory=Cosmetic)
    selection: Selection = field(default_factory=Selection)
    stacking: Stacking = field(default_factory=Stacking)
    colour: Colour = field(default_factory=Colour)
    merge: Merge = field(default_factory=Merge)
    drizzle: Drizzle = field(default_factory=Drizzle)
    display: Display = field(default_factory=Display)
    steps: list = field(default_factory=lambda: ["calibrate", "cosmetic", "debayer", "register", "select", "stack", "gradient", "colour", "drizzle", "cross_register", "merge", "display"])


def expand_env(value: Any, env: dict[str, str] | None = None) -> Any:
    """${NAME} and ${NAME:-default} in all strings of a tree; an unset name without default stays."""
    env = dict(os.environ) if env is None else env
    if isinstance(value, dict):
        return {k: expand_env(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [expand_env(v, env) for v in value]
    if isinstance(value, str):
        return re.sub(r"\$\{(\w+)(?::-([^}]*))?\}", lambda m: env.get(m[1], m[0] if m[2] is None else m[2]), value)
    return value


def deep_merge(base: dict, over: dict) -> dict:
    """Mappings merge, anything else is replaced; neither input changes."""
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def get_path(tree: dict, path: str, default: Any = None) -> Any:
    for part in path.split("."):
        if not isinstance(tree, dict) or part not in tree:
            return default
        tree = tree[part]
    return tree


def set_path(tree: dict, path: str, value: Any) -> dict:
    """A copy of the tree with the value at a dotted path."""
    head, _, rest = path.partition(".")
    child = tree.get(head)
    return {**tree, head: set_path(child if isinstance(child, dict) else {}, rest, value) if rest else value}


def load_tree(path: str) -> dict:
    """A JSON or YAML file (YAML needs its library) with environment variables expanded."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        import yaml

        return expand_env(yaml.safe_load(text) or {})
    return expand_env(json.loads(text))


def read_env_file(path: str) -> dict[str, str]:
    """NAME=value lines; quotes around values go, comments and blank lines are left out."""
    out = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            if m := re.match(r"\s*(?:export\s+)?(\w+)\s*=\s*(.*?)\s*$", line):
                out[m[1]] = m[2].strip("'\"")
    return out


def _build(cls: type, tree: dict) -> Any:
    known = {f.name: f for f in fields(cls)}
    unknown = set(tree) - set(known)
    if unknown:
        raise ValueError(f"unknown parameters: {', '.join(sorted(unknown))}")
    default = cls()
    made = {}
    for k, v in tree.items():
        now = getattr(default, k)
        made[k] = _build(type(now), v) if is_dataclass(now) and isinstance(v, dict) else v
    return cls(**made)


def resolve(*layers: dict | None) -> Params:
    """Parameters from layers of falling precedence (command line, file, config, preset); defaults last."""
    tree: dict = {}
    for layer in reversed(layers):
        tree = deep_merge(tree, layer or {})
    return _build(Params, tree)


def preset_for(target_type: str, presets: list[dict]) -> dict | None:
    """The first preset whose target_types has the type."""
    return next((p for p in presets if target_type in p.get("target_types", [])), None)
