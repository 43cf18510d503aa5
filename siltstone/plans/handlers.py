"""Requests without a web framework: each handler takes plain data and returns (status, JSON-ready body)."""

from __future__ import annotations

import datetime as dt
import json
import logging
from pathlib import Path
from typing import Any

from siltstone.operators.fields import BadConfig, BadQuery, FieldType
from siltstone.plans.engine import Request, SearchEngine, SourceResolver

log = logging.getLogger("siltstone.http")


def plain(value: Any) -> Any:
    """Dates as ISO text; NaN and infinities as null, which JSON lacks."""
    if isinstance(value, (dt.date, dt.datetime)):
        return value.isoformat()
    if isinstance(value, float) and (value != value or abs(value) == float("inf")):
        return None
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def error(status: int, kind: str, message: str) -> tuple[int, dict]:
    return status, {"error": {"type": kind, "message": message}}


class Handlers:
    def __init__(self, engine: SearchEngine, resolver: SourceResolver | None = None):
        self.engine, self.resolver = engine, resolver

    def dispatch(self, method: str, path: str, body: str | bytes | None = None) -> tuple[int, Any]:
        parts = [p for p in path.split("?")[0].split("/") if p]
        routes = {("health",): ("GET", lambda: (200, {"status": "ok"})), ("config",): ("GET", self.config), ("facets",): ("GET", self.facets), ("search",): ("POST", lambda: self.search(body))}
        if tuple(parts) in routes:
            wanted, run = routes[tuple(parts)]
        elif len(parts) == 2 and parts[0] == "documents":
            wanted, run = "GET", lambda: self.document(parts[1])
        elif len(parts) == 3 and parts[0] == "documents" and parts[2] == "source":
            wanted, run = "GET", lambda: self.source(parts[1])
        else:
            return error(404, "NotFound", f"no such path: {path}")
        if method != wanted:
            return error(405, "MethodNotAllowed", f"{path} takes {wanted}")
        try:
            return run()
        except BadQuery as e:
            return error(400, "BadQueryError", str(e))
        except BadConfig as e:
            return error(500, "BadConfigError", str(e))
        except Exception:
            log.exception("%s %s", method, path)
            return error(500, "InternalError", "an unexpected error occurred")

    def config(self) -> tuple[int, dict]:
        c = self.engine.config
        shown = sorted(c.controls.items(), key=lambda x: x[1].order)
        filters = []
        for name, control in shown:
            f = c.filters[name]
            filters.append({
                "name": name, "label": control.label, "control": control.control, "order": control.order, "placeholder": control.placeholder, "type": f.field.type.value,
                "item_type": f.field.item_type and f.field.item_type.value, "operation": f.operation, "required": f.field.required, "default": plain(f.default),
            })
        return 200, {
            "branding": c.branding, "labels": c.labels, "filters": filters, "result_card_fields": c.result_card_fields, "search": self.engine.capabilities(),
            "pagination": {"default_page_size": c.default_page_size, "max_page_size": c.max_page_size},
        }

    def facets(self) -> tuple[int, dict]:
        """Only fields that the form shows."""
        names = list(self.engine.config.controls)
        out: dict[str, dict] = {n: {"available_count": 0} for n in names}
        for n in names:
            if self.engine.config.filters[n].operation == "range":
                out[n] |= {"min": None, "max": None}
        for r in self.engine.facets(names).collect() if names else []:
            f, one = self.engine.config.filters[r.field].field, out[r.field]
            if r.kind == "available":
                one["available_count"] = r["count"]
            elif r.kind == "range":
                one |= {"min": self._number(r.low, f.type), "max": self._number(r.high, f.type)}
            else:
                one.setdefault("values", []).append({"value": self._typed(r.value, f.scalar), "count": r["count"]})
        for one in out.values():
            if "values" in one:
                one["values"].sort(key=lambda v: (str(v["value"]).casefold(), str(v["value"])))
        return 200, {"facets": out}

    @staticmethod
    def _number(x: float | None, kind: FieldType) -> Any:
        if x is None:
            return None
        if kind is FieldType.DATE:
            return (dt.date(1970, 1, 1) + dt.timedelta(days=int(x))).isoformat()
        return int(x) if kind is FieldType.INT else x

    @staticmethod
    def _typed(text: str, kind: FieldType) -> Any:
        return {FieldType.INT: int, FieldType.FLOAT: float, FieldType.BOOL: lambda t: t == "true"}.get(kind, str)(text)

    def search(self, body: str | bytes | None) -> tuple[int, dict]:
        try:
            raw = json.loads(body or "")
        except ValueError:
            raise BadQuery("the body is not JSON") from None
        result = self.engine.search(Request.parse(raw))
        names = [f.name for f in self.engine.config.fields]
        hits = []
        for r in result.hits.collect():
            row = r.asDict(recursive=True)
            hits.append({"id": row["id"], "score": row["score"], "matched_fields": row["matched_fields"], "metadata": {n: row[n] for n in names}, "document_url": f"/documents/{row['id']}"})
        i = result.info
        return 200, plain({"hits": hits, "page": i.page, "page_size": i.page_size, "total_hits": i.total_hits, "total_pages": i.total_pages, "has_previous": i.has_previous, "has_next": i.has_next})

    def document(self, key: str) -> tuple[int, dict]:
        row = self.engine.get_document(key)
        if row is None:
            return error(404, "NotFound", f"no document {key}")
        return 200, plain({"id": row.pop("id"), "text": row.pop("text"), "metadata": row, "source_url": f"/documents/{key}/source" if self.resolver else None})

    def source(self, key: str) -> tuple[int, Any]:
        row = self.engine.get_document(key)
        found = self.resolver(row) if row is not None and self.resolver else None
        if found is None or isinstance(found, Path) and not found.is_file():
            return error(404, "NotFound", f"no source of {key}")
        return 200, found.read_bytes() if isinstance(found, Path) else found
