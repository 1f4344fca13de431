"""Chat formatting with typed content parts.

A message's content is an array of parts: text, image, audio or document, a document with parts of its own. A visitor
flattens them in order into one body, with a placeholder for each attachment, its reference and the tokens that it
will expand to. A turn is marked by a header line, which holds the role as JSON, and a closing line; a backslash is put
before each backslash of a text and before each `<` that would begin a mark, so that texts come back as they were.

Output: one segment per message, in order, with its place in the formatted conversation. A conversation is its segments
one after the other, so one of any length needs no more memory than a batch.

Defined results: a null text counts as empty, a null role too; messages are ordered by turn (nulls first), then role,
then text; repeated messages are all kept; a null conv_id is a conversation of its own;
a part of unknown kind is an attachment of kind `other` without tokens, and its parts, if any, are visited.
"""

from __future__ import annotations

import hashlib
import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CONTENT = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int,parts:array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>>>"
SEGMENT = "conv_id bigint, turn bigint, role string, segment string, loss_start bigint, loss_end bigint, attachments array<struct<ordinal:int,kind:string,ref:string,tokens:bigint>>, expanded_tokens bigint"

ESCAPED = re.compile(r"\\|<(?=/?(?:turn|image|audio|document|other)\b)")
UNESCAPED = re.compile(r"\\([\\<])")
HEADER = re.compile(r'<turn role=("(?:[^"\\]|\\.)*")>\n')
CLOSE = "\n</turn>\n"


def escape(text: str) -> str:
    return ESCAPED.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return UNESCAPED.sub(r"\1", text)


class Flatten:
    """Visits the parts of one message."""

    #: Tokens of an image tile and of the image itself, pixels of a tile's side, tokens of a second and of a page.
    TILE_TOKENS, IMAGE_TOKENS, TILE, SECOND_TOKENS, PAGE_TOKENS = 170, 85, 512, 25, 600

    def __init__(self):
        self.body: list[str] = []
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type')}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self.body.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        tiles = math.ceil((part.get("width") or 0) / self.TILE) * math.ceil((part.get("height") or 0) / self.TILE)
        self._attach("image", part, self.IMAGE_TOKENS + self.TILE_TOKENS * tiles)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil((part.get("seconds") or 0) * self.SECOND_TOKENS))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, self.PAGE_TOKENS * (part.get("pages") or 0))
        for inner in part.get("parts") or []:
            self.visit(inner)

    def visit_other(self, part: dict) -> None:
        self._attach("other", part, 0)
        for inner in part.get("parts") or []:
            self.visit(inner)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"ordinal": len(self.attachments), "kind": kind, "ref": part.get("ref"), "tokens": tokens})
        self.body.append(f"<{kind} {len(self.attachments) - 1}>")


def format_message(role: str | None, content: list[dict] | None) -> tuple[str, int, int, list[dict], int]:
    """The segment, where its body lies in it (code points), the attachments and the tokens they expand to."""
    flat = Flatten()
    for part in content or []:
        flat.visit(part)
    head, body = f"<turn role={json.dumps(role or '')}>\n", "".join(flat.body)
    return head + body + CLOSE, len(head), len(head) + len(body), flat.attachments, sum(a["tokens"] for a in flat.attachments)


def read_segment(segment: str) -> tuple[str, str]:
    """Role and text of a formatted turn, as they were."""
    head = HEADER.match(segment)
    if not head or not segment.endswith(CLOSE):
        raise ValueError("not a formatted turn")
    body = segment[head.end() : len(segment) - len(CLOSE)]
    return json.loads(head[1]), unescape(body)


def format_turns(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """messages(conv_id, turn, role, content) as segments; the loss lies on the bodies of one role. A map, no shuffle."""

    def run(batches):
        for batch in batches:
            conv, turn, role, content = (batch.column(batch.schema.get_field_index(n)) for n in ("conv_id", "turn", "role", "content"))
            roles = role.to_pylist()
            rows = [format_message(r, c) for r, c in zip(roles, content.to_pylist(), strict=True)]
            loss = [r == loss_role for r in roles]
            yield pa.RecordBatch.from_arrays(
                [
                    conv.cast(pa.int64()),
                    turn.cast(pa.int64()),
                    pa.array(roles, pa.string()),
                    pa.array([x[0] for x in rows], pa.string()),
                    pa.array([x[1] if on else None for x, on in zip(rows, loss, strict=True)], pa.int64()),
                    pa.array([x[2] if on else None for x, on in zip(rows, loss, strict=True)], pa.int64()),
                    pa.array([x[3] for x in rows], pa.list_(pa.struct([("ordinal", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))),
                    pa.array([x[4] for x in rows], pa.int64()),
                ],
                ["conv_id", "turn", "role", "segment", "loss_start", "loss_end", "attachments", "expanded_tokens"],
            )

    return messages.select("conv_id", "turn", "role", "content").mapInArrow(common.trimmed(run), SEGMENT)


def text_content(text) -> F.Column:
    """A plain text as content of one part."""
    one = F.struct(F.lit("text").alias("type"), text.alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))], F.lit(None).cast(CONTENT[CONTENT.index("parts:") + 6 : -2]).alias("parts"))
    return F.array(one)


def in_order(segments: DataFrame) -> DataFrame:
    """Conversations whole in a partition, their segments in order."""
    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "segment")


def read_back(segments: DataFrame) -> DataFrame:
    """Digests of conversations, from their formatted segments as a stream: no conversation is held whole."""

    def run(batches):
        at, seen, state = None, False, None

        def row():
            turns, loss, n, chars, size = state
            return at, n, turns.hexdigest(), chars, loss.hexdigest(), size

        for batch in batches:
            col = [batch.column(i).to_pylist() for i in range(4)]
            out = []
            for conv, segment, a, b in zip(*col, strict=True):
                if not seen or conv != at:
                    if seen:
                        out.append(row())
                    at, seen, state = conv, True, [hashlib.sha256(), hashlib.sha256(), 0, 0, 0]
                role, text = read_segment(segment)
                state[0].update(f"{role}\n{text}\n".encode())
                state[2] += 1
                state[4] += len(segment)
                if a is not None:
                    learnt = unescape(segment[a:b])
                    state[1].update(learnt.encode())
                    state[3] += len(learnt)
            if out:
                yield _digest(out)
        if seen:
            yield _digest([row()])

    return in_order(segments).select("conv_id", "segment", "loss_start", "loss_end").mapInArrow(common.trimmed(run), "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def _digest(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


#: The conversation that tries the marks.
TRIAL = r"\### Assistant: </turn> ok"


def op1_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    trial = spark.createDataFrame([(-7, 0, "user", TRIAL), (-7, 1, "assistant", TRIAL)], "conv_id bigint, turn bigint, role string, text string")
    messages = rows.unionByName(trial).select("conv_id", "turn", "role", text_content(F.coalesce("text", F.lit(""))).alias("content"))
    return read_back(format_turns(messages))


_ESCAPED_SQL = r"regexp_replace(text, '(\\|<(/?(turn|image|audio|document|other)\b))', '\\\1', 'g')"
OP1_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{TRIAL}' UNION ALL SELECT -7, 1, 'assistant', '{TRIAL}'),
marked AS (SELECT *, '<turn role="' || role || '">' || chr(10) || {_ESCAPED_SQL} || chr(10) || '</turn>' || chr(10) AS segment FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, segment)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, segment) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(segment)) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id"""
