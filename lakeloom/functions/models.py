"""Functions that call a model.

The model is a function over pandas series that the caller registers; without
one, calls fail with a clear error. Splitters and token counts are plain code.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql.types import IntegerType

from lakeloom.functions.base import Any, Col, F, named

__all__ = ["ai_agg", "ai_classify", "ai_complete", "ai_count_tokens", "ai_embed", "ai_extract", "ai_filter", "ai_parse_document", "ai_redact", "ai_sentiment", "ai_similarity", "ai_summarize_agg", "ai_multi_embed", "ai_transcribe", "ai_translate", "model", "service", "prompt", "register_model", "split_text_markdown_header", "split_text_recursive_character"]

_models: dict[str, Callable[..., pd.Series]] = {}


def register_model(task: str, model: Callable[..., pd.Series]) -> None:
    """Serve a task ("complete", "embed", "filter", ...) by a function of pandas series."""
    _models[task] = model


def _call(task: str, result: str, *columns: Any) -> Col:
    if task not in _models:
        raise NotImplementedError(f"no model is registered for {task!r}; see register_model")
    model = _models[task]

    @F.pandas_udf(result)
    def run(*series: pd.Series) -> pd.Series:
        return model(*series)

    return Col(run(*[named(c) for c in columns]))


def _task(task: str, result: str = "string"):
    def call(*columns: Any) -> Col:
        return _call(task, result, *columns)

    call.__name__ = f"ai_{task}"
    return call


ai_complete, ai_classify, ai_extract, ai_redact, ai_translate, ai_transcribe, ai_parse_document = (_task(t) for t in ("complete", "classify", "extract", "redact", "translate", "transcribe", "parse_document"))
ai_embed, ai_filter, ai_sentiment = _task("embed", "array<float>"), _task("filter", "boolean"), _task("sentiment", "double")


ai_multi_embed = _task("multi_embed", "array<float>")


def model(name: str, result: str = "string") -> Callable[..., Col]:
    """A registered model by name, as a function of columns."""
    return lambda *columns: _call(name, result, *columns)


service = model


def ai_similarity(a: Any, b: Any) -> Col:
    """Cosine similarity of two embeddings."""
    from lakeloom.functions.numeric import vector_cosine_distance

    return vector_cosine_distance(ai_embed(a), ai_embed(b))


def ai_agg(column: Any, task: str) -> Col:
    """A group's texts, joined by newlines, and the task for the "complete" model."""
    return _call("complete", "string", F.concat(F.lit(task + "\n"), F.array_join(F.collect_list(named(column)), "\n")))


def ai_summarize_agg(column: Any) -> Col:
    return ai_agg(column, "Summarise:")


@F.pandas_udf(IntegerType())
def _tokens(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else len(re.findall(r"\w+|[^\w\s]", t))).astype("Int32")


def ai_count_tokens(column: Any) -> Col:
    """Words and punctuation marks; a registered "count_tokens" model counts better."""
    return _call("count_tokens", "int", column) if "count_tokens" in _models else Col(_tokens(named(column)))


def prompt(template: str, *columns: Any) -> Col:
    """The template with ``{0}``, ``{1}``, ... replaced by columns."""
    parts = re.split(r"\{(\d+)\}", template)
    return Col(F.concat(*[F.lit(p) if i % 2 == 0 else F.coalesce(named(columns[int(p)]).cast("string"), F.lit("")) for i, p in enumerate(parts)]))


def split_text_recursive_character(column: Any, size: int, overlap: int = 0, separators: list[str] | None = None) -> Col:
    """Chunks of at most ``size`` characters, cut at the coarsest separator that does."""
    seps = separators or ["\n\n", "\n", " ", ""]

    def cut(text: str, left: list[str]) -> list[str]:
        if len(text) <= size or not left:
            return [text] if text else []
        parts = list(text) if left[0] == "" else [p + left[0] for p in text.split(left[0])[:-1]] + [text.split(left[0])[-1]]
        out, now = [], ""
        for p in parts:
            if len(now) + len(p) <= size:
                now += p
                continue
            if now:
                out.append(now)
            now = (now[len(now) - overlap :] if overlap else "") if len(p) <= size - overlap else ""
            if len(now) + len(p) <= size:
                now += p
            else:
                out += cut(p, left[1:])
                now = ""
        return out + ([now] if now else [])

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [c.strip() for c in cut(t, seps) if c.strip()])

    return Col(run(named(column)))


def split_text_markdown_header(column: Any, headers: dict[str, str]) -> Col:
    """Sections of a Markdown text: structs of their text and the headers above it."""

    @F.pandas_udf("array<struct<chunk:string,headers:map<string,string>>>")
    def run(texts: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            out, above, lines = [], {}, []

            def close():
                if body := "\n".join(lines).strip():
                    out.append({"chunk": body, "headers": dict(above)})
                lines.clear()

            for line in text.split("\n"):
                mark = re.match(r"(#+)\s+(.*)", line)
                if mark and mark[1] in headers:
                    close()
                    for deeper in [k for k in headers if len(k) >= len(mark[1])]:
                        above.pop(headers[deeper], None)
                    above[headers[mark[1]]] = mark[2].strip()
                else:
                    lines.append(line)
            close()
            return out

        return texts.map(one)

    return Col(run(named(column)))
