"""Chat formatting with typed content parts.

A visitor flattens the parts of a turn (text, image, audio, document) into one string:
text is escaped, the others become ordered placeholders, with a record of what each
refers to and how many tokens it expands to. Control strings inside texts and roles
are escaped, so a formatted conversation can be read back without loss.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import extended, slices, table

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>\n"
#: What no text may contain unescaped: our marks (all begin with ``<|``) and those of common templates.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_OPENING = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS))
_ESCAPED = re.compile(r"\\(\\?)")
_TURN = re.compile(re.escape(TURN) + r"(.*?)" + re.escape(BODY) + r"(.*?)" + re.escape(END), re.S)
_PLACEHOLDER = re.compile(r"<\|(image|audio|document):(\d+)\|>")
LOSS_ROLES = ("assistant",)

PART = T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("seconds", T.DoubleType()), T.StructField("pages", T.IntegerType())])
ATTACHMENT = pa.struct([("index", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("offset", pa.int64()), ("tokens", pa.int64())])


def escape(text: str) -> str:
    """A backslash is doubled; the first character of a control string gets one after it."""
    return _OPENING.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


class Flattener:
    """Visits the parts of one turn in order. Unknown types raise ValueError; null fields count as absent."""

    def __init__(self, count_text: Callable[[str], int] = lambda text: len(text.encode().split()), patch: int = 14, audio_rate: float = 25.0, page_tokens: int = 256) -> None:
        self.count_text, self.patch, self.audio_rate, self.page_tokens = count_text, patch, audio_rate, page_tokens

    def visit(self, parts: list[dict] | None) -> tuple[str, list[dict], int]:
        """Flat body, attachments (their ``offset`` is in the body), tokens once placeholders are expanded."""
        out: list[str] = []
        attached: list[dict] = []
        at = tokens = 0
        for part in parts or []:
            kind = (part or {}).get("type") or "text"
            see = getattr(self, f"visit_{kind}", None)
            if see is None:
                raise ValueError(f"unknown content type {kind!r}")
            flat, n = see(part or {}, len(attached))
            if kind != "text":
                attached.append({"index": len(attached), "kind": kind, "ref": part.get("ref"), "offset": at, "tokens": n})
            out.append(flat)
            at += len(flat)
            tokens += n
        return "".join(out), attached, tokens

    def visit_text(self, part: dict, _: int) -> tuple[str, int]:
        text = part.get("text") or ""
        return escape(text), self.count_text(text)

    def visit_image(self, part: dict, k: int) -> tuple[str, int]:
        return f"<|image:{k}|>", math.ceil((part.get("width") or 0) / self.patch) * math.ceil((part.get("height") or 0) / self.patch)

    def visit_audio(self, part: dict, k: int) -> tuple[str, int]:
        return f"<|audio:{k}|>", math.ceil((part.get("seconds") or 0) * self.audio_rate)

    def visit_document(self, part: dict, k: int) -> tuple[str, int]:
        return f"<|document:{k}|>", (part.get("pages") or 0) * self.page_tokens


def format_turn(role: str | None, parts: list[dict] | None, flattener: Flattener) -> tuple:
    """Formatted turn, its loss spans, attachments and expanded tokens. Offsets are in code points of the formatted turn.

    Text of a loss role is under the mask, placeholders are not. A null role is empty.
    """
    body, attached, tokens = flattener.visit(parts)
    head = TURN + escape(role or "") + BODY
    spans = []
    if role in LOSS_ROLES:
        at = 0
        for m in _PLACEHOLDER.finditer(body):
            spans.append((at, m.start()))
            at = m.end()
        spans = [(len(head) + a, len(head) + b) for a, b in [*spans, (at, len(body))] if b > a]
    return head + body + END, spans, [a | {"offset": a["offset"] + len(head)} for a in attached], tokens


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
ADDED = (("formatted", pa.string()), ("loss_spans", pa.list_(SPAN)), ("attachments", pa.list_(ATTACHMENT)), ("expanded_tokens", pa.int64()))


def format_turns(df: DataFrame, content_col: str = "content", role_col: str = "role", flattener: Flattener | None = None) -> DataFrame:
    """All columns plus the formatted turn, its loss spans, attachments and expanded tokens.

    ``content_col`` is an array of PART, or a string that stands for one text part.
    A conversation is its formatted turns in order, so turns are formatted where they
    lie and none needs its neighbours, repeated rows agree, and an empty table stays empty.
    Null content is empty. Existing columns of these names are replaced.
    """
    from pyspark.sql.pandas.types import from_arrow_type

    df = df.drop(*(name for name, _ in ADDED))
    own = df.columns
    plain = isinstance(df.schema[content_col].dataType, T.StringType)
    flattener = flattener or Flattener()

    def run(batches):
        for batch in slices(batches):
            rows = []
            for role, content in zip(batch.column(role_col).to_pylist(), batch.column(content_col).to_pylist(), strict=True):
                formatted, spans, attached, tokens = format_turn(role, [{"type": "text", "text": content}] if plain else content, flattener)
                rows.append((formatted, [{"start": a, "end": b} for a, b in spans], attached, tokens))
            cols = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, k) for v, (_, k) in zip(cols, ADDED, strict=True))], [*own, *(name for name, _ in ADDED)])

    return df.mapInArrow(run, extended(df, *((name, from_arrow_type(kind)) for name, kind in ADDED)))


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and body text of a formatted turn, unescaped, placeholders left out."""
    m = _TURN.fullmatch(formatted)
    if m is None:
        raise ValueError("not a formatted turn")
    return unescape(m[1]), unescape(_PLACEHOLDER.sub("", m[2]))


DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(turns: DataFrame, conv_col: str = "conv_id", order: tuple[str, ...] = ("turn",)) -> DataFrame:
    """One row per conversation, from the formatted turns and the loss spans alone.

    Turns are ordered by ``order``, nulls first, then by their formatted form, so ties
    come out alike. Conversations are dealt by id and read one turn at a time: a long
    one takes time on one task, but no memory. (A SHA-256 over a conversation is serial;
    everything before it, formatting included, has been done where the rows lay.)
    """
    schema = T.StructType([turns.schema[conv_col]])
    for field in DIGEST.split(", "):
        schema = schema.add(*field.split())
    rows = turns.select(conv_col, *order, "formatted", "loss_spans")
    rows = rows.repartition(F.col(conv_col)).sortWithinPartitions(conv_col, *order, "formatted")

    def run(batches):
        nothing = object()
        conv, out = nothing, []
        n = loss = chars = 0
        turn_sha = loss_sha = None
        for batch in slices(batches):
            for key, formatted, spans in zip(batch.column(conv_col).to_pylist(), batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist(), strict=True):
                if key != conv or conv is nothing:
                    if conv is not nothing:
                        out.append((conv, n, turn_sha.hexdigest(), loss, loss_sha.hexdigest(), chars))
                    conv, n, loss, chars, turn_sha, loss_sha = key, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                role, text = read_turn(formatted)
                turn_sha.update(f"{role}\n{text}\n".encode())
                masked = "".join(unescape(formatted[s["start"] : s["end"]]) for s in spans)
                loss_sha.update(masked.encode())
                n, loss, chars = n + 1, loss + len(masked), chars + len(formatted)
            if out:
                yield _digests(out, schema)
                out = []
        if conv is not nothing:
            yield _digests([(conv, n, turn_sha.hexdigest(), loss, loss_sha.hexdigest(), chars)], schema)

    return rows.mapInArrow(run, schema)


def _digests(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)


#: The conversation that op2 adds: both texts hold control strings of other templates.
EXTRA = ((-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"))


def op2_chat(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(list(EXTRA), turns.schema)
    return read_back(format_turns(turns.unionByName(extra), "text"))


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *,
        regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(\||s>|/s>|<SYS>>|</SYS>>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g') AS body
      FROM t),
f AS (SELECT *, '<|turn|>' || role || '<|body|>' || body || '<|end|>' || chr(10) AS formatted FROM e)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, formatted)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, formatted), '')) AS loss_sha256,
       CAST(sum(length(formatted)) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
