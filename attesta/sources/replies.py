"""Where replies come from: a stored table, a live model server, or a rule that makes them for tests."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Iterable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import shout
from attesta.operators.chunking import sentences
from attesta.schemas import CONFIDENCES, REPLIES, REPLY_JSON_SCHEMA, TYPES
from attesta.session import cut, ship

GLEAN = "List any further facts from the same text that your answer left out, in the same format. If there are none, return an empty list."


class Extractor(Protocol):
    def __call__(self, chunks: DataFrame) -> DataFrame:
        """``doc_id, chunk_no, chunk_text`` to the columns of ``attesta.schemas.REPLIES``."""


def replayed(replies: DataFrame) -> Extractor:
    """Stored replies of the wanted chunks."""
    return lambda chunks: replies.join(chunks.select("doc_id", "chunk_no"), ["doc_id", "chunk_no"], "left_semi")


def request(settings, system: str, messages: list[dict], schema: dict = REPLY_JSON_SCHEMA) -> dict:
    """The body of one chat request; ``think`` is left out only where it is not set at all."""
    body = {"model": settings.model, "messages": [{"role": "system", "content": system}, *messages], "stream": False, "format": schema, "options": settings.options}
    if settings.keep_alive:
        body["keep_alive"] = settings.keep_alive
    return body if settings.think is None else body | {"think": settings.think}


class ServerError(RuntimeError):
    """A model server that cannot be reached, or that answers with an error."""


def _ask(url: str, body: dict | None, timeout: float) -> dict:
    """The JSON that a server sends: what it says about its errors is kept."""
    call = urllib.request.Request(url, None if body is None else json.dumps(body).encode(), {"Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(call, timeout=timeout) as answer:
            raw = answer.read()
    except urllib.error.HTTPError as e:
        raise ServerError(f"{url} answered {e.code} {e.reason}: {e.read().decode(errors='replace').strip()}") from None
    except OSError as e:
        raise ServerError(f"{url} cannot be reached: {getattr(e, 'reason', e)}. Is the model server running there, and is that the host in the settings?") from None
    try:
        got = json.loads(raw)
    except ValueError as e:
        raise ServerError(f"{url} sent no JSON: {e}") from None
    if isinstance(got, dict) and got.get("error"):
        raise ServerError(f"{url} reports: {got['error']}")
    return got


def _post(url: str, body: dict, timeout: float) -> dict:
    return _ask(url, body, timeout)


def _get(url: str, timeout: float) -> dict:
    return _ask(url, None, timeout)


def live(settings, system: str, slots: int = 1, timeout: float = 1800.0, post=_post, schema: dict = REPLY_JSON_SCHEMA) -> Extractor:
    """Replies of a model server. A task asks for one chunk at a time, its passes in one growing thread.

    The replies are written before anything reads them: a retried task downstream must not ask again.
    """

    def extract(chunks: DataFrame) -> DataFrame:
        spark = ship(chunks.sparkSession)
        names = [c.split()[0] for c in REPLIES.split(", ")]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string()]

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for doc, no, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    messages, rows = [{"role": "user", "content": text}], []
                    for k in range(1, settings.passes + 1):
                        got = post(f"{settings.host.rstrip('/')}/api/chat", request(settings, system, messages, schema), timeout)
                        said = got.get("message", {})
                        rows.append((doc, no, k, said.get("content", ""), said.get("thinking"), got.get("prompt_eval_count", 0), got.get("eval_count", 0), got.get("eval_duration", 0), got.get("done_reason", "")))
                        messages += [{"role": "assistant", "content": said.get("content", "")}, {"role": "user", "content": GLEAN}]
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

        dealt = chunks.select(F.col("doc_id").cast("bigint").alias("doc_id"), "chunk_no", "chunk_text").repartition(slots)
        return cut(dealt.mapInArrow(run, REPLIES), spark)

    return extract


def supports_thinking(settings, timeout: float = 30.0, post=_post) -> bool:
    """Whether the server says that the model can think."""
    return "thinking" in post(f"{settings.host.rstrip('/')}/api/show", {"model": settings.model}, timeout).get("capabilities", [])


def has_model(settings, listing: dict) -> bool:
    """Whether a server's listing names the model, with or without ``:latest``."""
    bare = settings.model.removesuffix(":latest")
    return any(m.get("name", "").removesuffix(":latest") == bare for m in listing.get("models", []))


def preflight(settings, timeout: float = 30.0, get=_get) -> None:
    """Ask the server for its models; an error where it does not answer or lacks the one that is wanted."""
    listing = get(f"{settings.host.rstrip('/')}/api/tags", timeout)
    if not has_model(settings, listing):
        names = ", ".join(sorted(m.get("name", "") for m in listing.get("models", []))) or "none"
        raise ServerError(f"the server at {settings.host} has no model {settings.model!r}; it has: {names}")


def wanted_thinking(settings, off: bool = False, post=_post):
    """What a request says about thinking: nothing for a model that cannot, else the settings' value, or false."""
    if not supports_thinking(settings, post=post):
        return None
    return False if off else settings.think


def ruled_claims(text: Column, number: Column) -> Column:
    """A rule's claims about a text: each sentence, its span exact, upper-cased, with a full stop added, altered, or missing, in turn.

    A synthetic stand-in for a model, for tests and for queries on tables without replies.
    """

    def claim(s: Column, i: Column) -> Column:
        way = (i + number) % 6
        span = F.when(way == 0, s).when(way == 1, shout(s)).when(way == 2, F.concat(s, F.lit("."))).when(way == 3, F.concat(F.lit("Zq "), s))
        kind = F.element_at(F.array(*map(F.lit, TYPES)), ((i + number) % len(TYPES)).cast("int") + 1)
        sure = F.when(way == 5, F.lit("low")).otherwise(F.element_at(F.array(*map(F.lit, CONFIDENCES)), ((i + number) % 2).cast("int") + 1))
        return F.struct((i + 1).cast("int").alias("id"), s.alias("fact"), kind.alias("type"), sure.alias("confidence"), span.alias("verbatim"))

    return F.transform(sentences(text), claim)


def ruled(chunks: DataFrame) -> DataFrame:
    """Replies made by :func:`ruled_claims`, as a model would send them."""
    content = F.to_json(F.struct(ruled_claims(F.col("chunk_text"), F.col("doc_id") + F.col("chunk_no")).alias("facts")), {"ignoreNullFields": "false"})
    size = F.length("chunk_text")
    return chunks.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "chunk_no", F.lit(1).alias("pass_no"), content.alias("content"), F.lit(None).cast("string").alias("thinking"),
        (size / 4).cast("int").alias("prompt_n"), (F.length(content) / 4).cast("int").alias("predicted_n"), (F.length(content).cast("bigint") * 1000000).alias("eval_duration_ns"), F.lit("stop").alias("done_reason"),
    )
