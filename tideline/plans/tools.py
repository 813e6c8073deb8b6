"""The corpus tools by name, each with a JSON schema of its arguments, and a dispatch that answers instead of raising.

Every tool sees only what a point-in-time corpus lets through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.replies import first_problem
from ..functions.text import truncate_head
from ..operators import search as S
from ..operators import texts as X
from ..operators.pit import PointInTime

#: An answer holds at most so many rows, and of each text so many characters.
MAX_ROWS, MAX_CHARS = 25, 8000

_TEXT, _COUNT = {"type": "string"}, {"type": "number"}


def _schema(required: list[str], **properties: dict) -> dict:
    return {"type": "object", "required": required, "properties": properties}


def _one(known: PointInTime, doc_id) -> DataFrame:
    return known.documents().where(F.col("doc_id").cast("string") == str(doc_id))


def _listed(known: PointInTime, company: str | None = None) -> DataFrame:
    return known.visible(company).select("doc_id", "published_at", "document_type", "title")


def _lines(known: PointInTime, doc_id, first: float = 1, last: float = 200) -> DataFrame:
    return X.lines(_one(known, doc_id)).where(F.col("line").between(int(first), int(last))).orderBy("line")


def _section(known: PointInTime, doc_id, index: float) -> DataFrame:
    return X.sections(_one(known, doc_id)).where(F.col("index") == int(index)).join(_one(known, doc_id).select("doc_id", "text"), "doc_id").select("title", F.array_join(F.slice(F.split("text", "\n"), F.col("first"), F.col("last") - F.col("first") + 1), "\n").alias("text"))


def _corpus(known: PointInTime, query: str, company: str | None = None, limit: float = 10) -> DataFrame:
    p = S.line_passages(known.documents(), S.FILTERS)
    return S.search(p, query, known.cutoff, int(limit), where=S.wanted(company)).select("doc_id", "published_at", "ordinal", "text", "score")


TOOLS: dict[str, tuple[dict, Callable[..., DataFrame]]] = {
    "list_documents": (_schema([], company=_TEXT), _listed),
    "outline": (_schema(["doc_id"], doc_id={}), lambda known, doc_id: X.sections(_one(known, doc_id)).orderBy("index")),
    "section": (_schema(["doc_id", "index"], doc_id={}, index=_COUNT), _section),
    "lines": (_schema(["doc_id"], doc_id={}, first=_COUNT, last=_COUNT), _lines),
    "search_document": (_schema(["doc_id", "pattern"], doc_id={}, pattern=_TEXT), lambda known, doc_id, pattern: X.find_in_text(_one(known, doc_id), pattern)),
    "search_corpus": (_schema(["query"], query=_TEXT, company=_TEXT, limit=_COUNT), _corpus),
    "tables": (_schema(["doc_id"], doc_id={}, contains=_TEXT), lambda known, doc_id, contains=None: X.tables(_one(known, doc_id), contains=contains, most=6)),
    "numbers": (_schema(["doc_id", "pattern"], doc_id={}, pattern=_TEXT), lambda known, doc_id, pattern: X.numbers_near(_one(known, doc_id), pattern)),
}


def dispatch(known: PointInTime, name: str, arguments: dict) -> tuple[list[dict], str | None]:
    """(rows, None), or no rows and what was wrong: an unknown tool, arguments that break its schema, or a failure of the tool."""
    if name not in TOOLS:
        return [], f"no tool {name}"
    schema, run = TOOLS[name]
    given = {k: v for k, v in arguments.items() if v is not None} if isinstance(arguments, dict) else arguments
    if problem := first_problem(given, schema) or next((f"/{k}: unknown" for k in given if k not in schema["properties"]), None):
        return [], problem
    try:
        out = run(known, **given)
        short: list[Column] = [truncate_head(F.col(c), MAX_CHARS).alias(c) if t == "string" else F.col(c) for c, t in out.dtypes]
        return [r.asDict() for r in out.select(*short).limit(MAX_ROWS).collect()], None
    except Exception as e:  # noqa: BLE001 - the caller gets the reason as an answer
        return [], f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"


def isolated(names: list[str], run: Callable[[str], object]) -> tuple[dict[str, object], dict[str, str]]:
    """(results, errors) of one run per name; a run that fails keeps none of the others from finishing."""
    results, errors = {}, {}
    for n in names:
        try:
            results[n] = run(n)
        except Exception as e:  # noqa: BLE001 - reported by name
            errors[n] = f"{type(e).__name__}: {e}"
    return results, errors
