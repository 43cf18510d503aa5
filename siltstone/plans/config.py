"""Project configuration: a YAML file, read strictly.

Every problem found is reported, in one BadConfig.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

from siltstone.operators.fields import OPERATIONS, BadConfig, BadQuery, FieldDef, FieldType, coerce
from siltstone.operators.ranking import strategy
from siltstone.operators.semantic import combination

VERSIONS = {1}
NAME = re.compile(r"[a-zA-Z_][a-zA-Z0-9_]*")
S = FieldType
# The controls that a form may show for a field, the first by default.
CONTROLS = {
    (S.STRING, "equality"): ("dropdown", "radio"),
    (S.STRING, "contains"): ("text",),
    (S.DATE, "equality"): ("date",),
    (S.DATE, "range"): ("date_range",),
    (S.INT, "equality"): ("number", "dropdown"),
    (S.INT, "range"): ("number_range",),
    (S.FLOAT, "equality"): ("number",),
    (S.FLOAT, "range"): ("number_range",),
    (S.BOOL, "equality"): ("checkbox", "toggle"),
    (S.LIST, "contains"): ("multi_select", "checkbox_group"),
}
RANGE_KEYS = {"min", "max", "min_inclusive", "max_inclusive"}


@dataclass(frozen=True)
class FilterConfig:
    field: FieldDef
    operation: str
    default: Any = None  # declared for forms; the engine never applies it by itself


@dataclass(frozen=True)
class Control:
    label: str
    control: str
    order: int
    placeholder: str | None = None


@dataclass
class Config:
    filters: dict[str, FilterConfig]
    semantic_enabled: bool = True
    combination: str = "max_score"
    embedder: dict[str, Any] | None = None
    lexical_enabled: bool = True
    ranking: str = "weighted_sum"
    weights: tuple[float, float] = (0.5, 0.5)
    default_page_size: int = 20
    max_page_size: int = 100
    branding: dict[str, Any] = field(default_factory=dict)
    labels: dict[str, str] = field(default_factory=dict)
    controls: dict[str, Control] = field(default_factory=dict)
    result_card_fields: list[str] = field(default_factory=list)

    @property
    def fields(self) -> list[FieldDef]:
        """The metadata schema that ingestion types records by."""
        return [f.field for f in self.filters.values()]


class _Reader:
    """Takes keys out of nested mappings and keeps a list of what is wrong."""

    def __init__(self):
        self.problems: list[str] = []

    def wrong(self, where: str, what: str) -> None:
        self.problems.append(f"{where}: {what}")

    def section(self, value: Any, where: str, keys: set[str]) -> dict:
        if value is None:
            return {}
        if not isinstance(value, dict):
            self.wrong(where, "not a mapping")
            return {}
        for k in value:
            if k not in keys:
                self.wrong(where, f"unknown key {k!r}")
        return value

    def get(self, section: dict, key: str, kind: type | tuple, default: Any, where: str) -> Any:
        v = section.get(key, default)
        number = kind in (int, float, (int, float))
        if v is not default and (not isinstance(v, kind) or number and isinstance(v, bool)):
            self.wrong(f"{where}.{key}", f"{v!r} is of the wrong type")
            return default
        return v


def _default_problem(default: Any, scalar: FieldType, operation: str) -> str | None:
    try:
        if operation == "range":
            if not isinstance(default, dict) or set(default) - RANGE_KEYS:
                return f"a default range has the keys {sorted(RANGE_KEYS)}"
            for k, v in default.items():
                if k in ("min", "max"):
                    coerce(v, scalar)
                elif not isinstance(v, bool):
                    return f"{k} is true or false"
        else:
            values = default if isinstance(default, list) else [default]
            if not values:
                return "an empty list is no default"
            for v in values:
                coerce(v, scalar)
    except BadQuery as e:
        return str(e)
    return None


def _filter(name: str, raw: Any, r: _Reader) -> FilterConfig | None:
    where = f"filters.{name}"
    if not NAME.fullmatch(str(name)):
        r.wrong(where, "a name has letters, digits and _, no digit first")
        return None
    s = r.section(raw, where, {"type", "item_type", "required", "operation", "default"})
    kinds = {k.value: k for k in FieldType}
    if s.get("type") not in kinds or s.get("item_type") not in (None, *kinds):
        r.wrong(where, f"type and item_type are among {sorted(kinds)}")
        return None
    try:
        field_def = FieldDef(name, kinds[s["type"]], kinds.get(s.get("item_type")), r.get(s, "required", bool, False, where))
    except BadConfig as e:
        r.wrong(where, str(e))
        return None
    if s.get("operation") not in OPERATIONS[field_def.type]:
        r.wrong(where, f"operation {s.get('operation')!r} isn't among {sorted(OPERATIONS[field_def.type])}")
        return None
    default = s.get("default")
    if default is not None and (problem := _default_problem(default, field_def.scalar, s["operation"])):
        r.wrong(where, f"default: {problem}")
    return FilterConfig(field_def, s["operation"], default)


def _controls(raw: Any, filters: dict[str, FilterConfig], r: _Reader) -> dict[str, Control]:
    out: dict[str, Control] = {}
    for name, value in r.section(raw, "frontend.filters", set(raw or {}) if isinstance(raw, dict) else set()).items():
        where = f"frontend.filters.{name}"
        if name not in filters:
            r.wrong(where, "no such filter")
            continue
        s = r.section(value, where, {"label", "control", "order", "placeholder"})
        allowed = CONTROLS[filters[name].field.type, filters[name].operation]
        label, order = r.get(s, "label", str, "", where), r.get(s, "order", int, None, where)
        control = s.get("control") or allowed[0]
        if not label.strip():
            r.wrong(where, "label is blank")
        if order is None:
            r.wrong(where, "order is missing")
        if control not in allowed:
            r.wrong(where, f"control {control!r} isn't among {list(allowed)}")
        out[name] = Control(label, control, order or 0, s.get("placeholder"))
    orders = [c.order for c in out.values()]
    if len(set(orders)) < len(orders):
        r.wrong("frontend.filters", "an order is given twice")
    return out


def parse(raw: Any) -> Config:
    r = _Reader()
    if not isinstance(raw, dict):
        raise BadConfig("the configuration is empty or no mapping")
    top = r.section(raw, "top level", {"schema_version", "filters", "search", "frontend"})
    if top.get("schema_version") not in VERSIONS or isinstance(top.get("schema_version"), bool):
        r.wrong("schema_version", f"among {sorted(VERSIONS)}")
    for needed in ("search", "frontend"):
        if needed not in top:
            r.wrong(needed, "missing")
    named = top.get("filters") or {}
    if not isinstance(named, dict):
        r.wrong("filters", "not a mapping")
        named = {}
    filters = {n: f for n, raw_filter in named.items() if (f := _filter(n, raw_filter, r))}

    search = r.section(top.get("search"), "search", {"semantic", "lexical", "ranking", "pagination"})
    semantic = r.section(search.get("semantic"), "search.semantic", {"enabled", "multi_query_combination", "embedder"})
    lexical = r.section(search.get("lexical"), "search.lexical", {"enabled"})
    ranking = r.section(search.get("ranking"), "search.ranking", {"strategy", "weights"})
    weights = r.section(ranking.get("weights"), "search.ranking.weights", {"semantic", "lexical"})
    paging = r.section(search.get("pagination"), "search.pagination", {"default_page_size", "max_page_size"})
    embedder = r.section(semantic.get("embedder"), "search.semantic.embedder", {"provider", "model", "document_prefix", "query_prefix", "device", "batch_size", "cache_path"}) or None
    if embedder is not None:
        embedder = {"provider": "sentence_transformer", "document_prefix": "passage: ", "query_prefix": "query: ", "batch_size": 32} | embedder
        if not embedder.get("model"):
            r.wrong("search.semantic.embedder", "model is missing")
        if not isinstance(embedder["batch_size"], int) or embedder["batch_size"] < 1:
            r.wrong("search.semantic.embedder", "batch_size is at least 1")
    frontend = r.section(top.get("frontend"), "frontend", {"branding", "labels", "filters", "result_card_fields"})
    branding = frontend.get("branding") or {}
    if not isinstance(branding, dict) or not str(branding.get("title") or "").strip():
        r.wrong("frontend.branding", "title is missing")
        branding = {}
    colour = branding.get("primary_color")
    if colour is not None and not re.fullmatch("#[0-9A-Fa-f]{6}", str(colour)):
        r.wrong("frontend.branding.primary_color", "six hex digits behind #")
    if branding.get("direction", "ltr") not in ("ltr", "rtl"):
        r.wrong("frontend.branding.direction", "ltr or rtl")

    out = Config(
        filters,
        r.get(semantic, "enabled", bool, True, "search.semantic"),
        r.get(semantic, "multi_query_combination", str, "max_score", "search.semantic"),
        embedder,
        r.get(lexical, "enabled", bool, True, "search.lexical"),
        r.get(ranking, "strategy", str, "weighted_sum", "search.ranking"),
        tuple(float(r.get(weights, k, (int, float), 0.5, "search.ranking.weights")) for k in ("semantic", "lexical")),
        r.get(paging, "default_page_size", int, 20, "search.pagination"),
        r.get(paging, "max_page_size", int, 100, "search.pagination"),
        branding,
        dict(frontend.get("labels") or {}),
        _controls(frontend.get("filters"), filters, r),
        list(frontend.get("result_card_fields") or []),
    )
    for look, name in ((combination, out.combination), (strategy, out.ranking)):
        try:
            look(name)
        except ValueError as e:
            r.problems.append(str(e))
    if not (out.semantic_enabled or out.lexical_enabled):
        r.wrong("search", "neither mode is enabled")
    if min(out.weights) < 0 or not sum(out.weights):
        r.wrong("search.ranking.weights", "not negative, and not both 0")
    if out.default_page_size < 1 or out.default_page_size > out.max_page_size:
        r.wrong("search.pagination", "1 <= default_page_size <= max_page_size")
    if r.problems:
        raise BadConfig("; ".join(r.problems))
    return out


def load(path: str) -> Config:
    place = Path(path)
    if not place.is_file():
        raise BadConfig(f"{path} is no file")
    try:
        raw = yaml.safe_load(place.read_text(encoding="utf-8"))
    except (OSError, UnicodeDecodeError, yaml.YAMLError) as e:
        raise BadConfig(f"{path} can't be read: {e}") from e
    try:
        return parse(raw)
    except BadConfig as e:
        raise BadConfig(f"{path}: {e}") from e
