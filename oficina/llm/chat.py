"""Conversations as model input: a template as a black box, each turn's place in its output, the loss mask.

A template is any function from turns [(role, text), ...] to a text. It is rendered over every prefix of a
conversation, and each output is compared with the one before. Where that one still stands at the start, the new
characters are the turn's span. Where it doesn't, the template has rewritten history: the turn is marked,
turns whose text no longer stands there as it was have no span, and the span of one whose end only was rewritten is cut. Within a turn's span its text is found by
rendering the same prefix with a mark in the text's place: what stands before and after the mark is the template's.

The inner loop renders n prefixes of a conversation of n turns, so its work grows with the square of n; memory is two
outputs of one conversation. Turns reach a task sorted, as a stream, and only the conversation at hand is held.

The template of the query, ``INST``, marks turns and escapes control strings: a backslash is doubled and one is put after
a control string's first character, so that none is left in a text, and taking backslashes away gives the text back.

Defined results: a null text or role is an empty one. Turns are ordered by turn (null first), then role, then
text, so ties and repeated rows have one order and each stays a turn. Rows of a null conversation id are one
conversation. A role other than user and assistant is written into its turn. An empty table gives no rows. Other columns do not matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import short_batches

Turn = tuple[str, str]
#: Stands in a text's place while the template's own characters around it are looked for.
MARK = "\ue000\ue001"
#: Characters of output in one batch, about.
OUT_CHARS = 1 << 20
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_TO_ESCAPE = re.compile("|".join([r"\\", *map(re.escape, CONTROLS)]))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_HEAD = re.compile(r"((?:[^\\\n]|\\.)*)\n", re.DOTALL)


@dataclass(frozen=True)
class Template:
    """``render`` turns conversations into text, ``read`` gives the turns back, ``unescape`` restores a text as it stands in the output."""

    render: Callable[[list[Turn]], str]
    read: Callable[[str], list[Turn]] | None = None
    unescape: Callable[[str], str] = str


@dataclass
class Rendered:
    """An output, for each turn its span and its text's span (None: the turn no longer stands there), and the turns that rewrote history."""

    text: str = ""
    spans: list[tuple[int, int] | None] = field(default_factory=list)
    texts: list[tuple[int, int] | None] = field(default_factory=list)
    rewrites: list[int] = field(default_factory=list)


def common(a: str, b: str) -> int:
    """The length of the longest common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def trace(turns: list[Turn], render: Callable[[list[Turn]], str]) -> Rendered:
    """Render every prefix and compare each output with the one before."""
    out = Rendered(render([]))
    for k in range(len(turns)):
        now = render(turns[: k + 1])
        kept = len(out.text)
        if not now.startswith(out.text):
            kept = common(out.text, now)
            out.rewrites.append(k)
            out.texts = [t if t and t[1] <= kept else None for t in out.texts]
            out.spans = [(s[0], min(s[1], kept)) if s and t else None for s, t in zip(out.spans, out.texts)]
        out.spans.append((kept, len(now)))
        # The same prefix with the mark as its last text: equal up to the text and after it.
        marked = render([*turns[:k], (turns[k][0], MARK)])
        at = marked.find(MARK, kept)
        tail = len(marked) - at - len(MARK)
        sound = 0 <= at and at + tail <= len(now) and now[:at] == marked[:at] and (not tail or now[-tail:] == marked[-tail:])
        out.texts.append((at, len(now) - tail) if sound else None)
        out.text = now
    return out


def loss_text(turns: list[Turn], found: Rendered, template: Template, role: str = "assistant") -> str:
    """The text under the loss mask: each text of ``role`` that still has its place, as it was before it was escaped."""
    return "".join(template.unescape(found.text[t[0] : t[1]]) for (r, _), t in zip(turns, found.texts) if r == role and t)


def rewrites_history(template: Template, turns: list[Turn]) -> bool:
    return bool(trace(turns, template.render).rewrites)


@lru_cache(maxsize=1024)
def escaped(text: str) -> str:
    return _TO_ESCAPE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text) if "\\" in text or "<" in text or "[" in text else text


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def _inst(turns: list[Turn]) -> str:
    out = []
    for role, text in turns:
        if role == "user":
            out.append(f"<s>[INST] {escaped(text)} [/INST]")
        elif role == "assistant":
            out.append(f" {escaped(text)}</s>")
        else:
            name = escaped(role).replace("\n", "\\\n")
            out.append(f"<<SYS>>{name}\n{escaped(text)}<</SYS>>")
    return "".join(out)


def _read_inst(output: str) -> list[Turn]:
    turns, at = [], 0
    while at < len(output):
        if output.startswith("<s>[INST] ", at):
            end = output.index(" [/INST]", at)
            turns.append(("user", unescaped(output[at + 10 : end])))
            at = end + 8
        elif output.startswith("<<SYS>>", at):
            head = _HEAD.match(output, at + 7)
            end = output.index("<</SYS>>", head.end())
            turns.append((unescaped(head[1]), unescaped(output[head.end() : end])))
            at = end + 8
        else:
            end = output.index("</s>", at)
            turns.append(("assistant", unescaped(output[at + 1 : end])))
            at = end + 4
    return turns


INST = Template(_inst, _read_inst, unescaped)


def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[Turn]]]:
    """(id, turns) of rows (id, role, text) that come sorted by id."""
    current, turns = None, []
    for b in batches:
        for key, role, text in zip(*[b.column(i).to_pylist() for i in range(3)]):
            if turns and key != current:
                yield current, turns
                turns = []
            current = key
            turns.append((role or "", text or ""))
    if turns:
        yield current, turns


_OUT = pa.schema([
    ("text", pa.string()), ("spans", pa.list_(pa.list_(pa.int64()))), ("texts", pa.list_(pa.list_(pa.int64()))), ("rewrites", pa.list_(pa.int32())),
    ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
])
_SPARK = "text string, spans array<array<long>>, texts array<array<long>>, rewrites array<int>, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _formatted(batches: Iterator[pa.RecordBatch], template: Template) -> Iterator[pa.RecordBatch]:
    first = next(batches, None)
    if first is None:
        return
    key = first.schema.field(0)
    schema = pa.schema([key, *_OUT])
    rows, held = [], 0
    for conv, turns in conversations(chain([first], batches)):
        found = trace(turns, template.render)
        back = template.read(found.text) if template.read else turns
        all_turns = hashlib.sha256()
        for role, text in back:
            all_turns.update(f"{role}\n{text}\n".encode())
        loss = loss_text(back, found, template)
        rows.append({
            key.name: conv, "text": found.text, "spans": found.spans, "texts": found.texts, "rewrites": found.rewrites, "n_turns": len(back), "turns_sha256": all_turns.hexdigest(),
            "loss_chars": len(loss), "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(), "formatted_chars": len(found.text),
        })
        held += len(found.text)
        if held > OUT_CHARS:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def formatted(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, template: Template = INST) -> DataFrame:
    """A row for each conversation: its id, the output, the spans of turns and of their texts, and digests read back from the output.

    ``rewrites`` are the turns at which the template changed what it had written before.
    """
    short_batches(df.sparkSession)
    rows = df.select(F.col(conv_col).alias("__c"), F.col(role_col).alias("__r"), F.col(text_col).alias("__x"), F.col(turn_col).alias("__t"))
    rows = rows.repartition("__c").sortWithinPartitions("__c", "__t", "__r", "__x").select("__c", "__r", "__x")
    kind = df.schema[conv_col].dataType.simpleString()
    return rows.mapInArrow(lambda b: _formatted(b, template), f"__c {kind}, {_SPARK}").withColumnRenamed("__c", conv_col)


#: One more conversation, whose texts are control strings.
EXTRA = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(EXTRA, "conv_id long, turn long, role string, text string"))
    out = formatted(rows, "conv_id", "turn", "role", "text")
    return out.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", F.size("rewrites").alias("n_rewrites"))


_CONTROL_SQL = r"\\|" + "|".join(c.replace("[", r"\[").replace("]", r"\]") for c in CONTROLS)
SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT *, len(regexp_extract_all(text, '{_CONTROL_SQL}')) AS n_text, len(regexp_extract_all(role, '{_CONTROL_SQL}|\n')) AS n_role FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(text) + n_text + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 5 ELSE 16 + length(role) + n_role END)::BIGINT AS formatted_chars,
  0 AS n_rewrites
FROM t GROUP BY conv_id"""
