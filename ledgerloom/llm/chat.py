"""Operator 12 - chat formatting with compiled templates.

A conversation is the rows of one conv_id in the order of turn (null first; rows
of one turn by role and text).  Rows are dealt by conversation, sorted by Spark,
and stream through the compiled template: it reads one turn ahead, and what it
has written leaves the task as parts of whole turns, each of about ``PART`` code
points.  So a task holds a turn and a part, however long a conversation is.  A
template may look back and count turns, and a digest of a text is sequential,
so one conversation is rendered by one task; others never wait in its memory.

Control strings inside roles and texts are escaped (``templates.Escaper``), so
the formatted text can be cut into its turns again: ``read_turns``.

Null roles and texts count as empty; rows without a conv_id are one
conversation; repeated rows are turns of their own; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, give_back, store, table
from .templates import Escaper, Template

#: Strings that mark turns, and those that tokenizers of chat models take for marks.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[TEXT]", "[/ROLE]"]
TEMPLATE = """
{%- for m in messages -%}
  {%- if m.role == 'user' -%} [INST] {{- ' ' ~ m.text | escape ~ ' ' -}} [/INST]
  {%- elif m.role == 'assistant' -%} {{- ' ' -}} {%- generation -%} {{- m.text | escape -}} {%- endgeneration -%} </s>
  {%- else -%} [ROLE] {{- ' ' ~ m.role | escape ~ ' [TEXT] ' ~ m.text | escape ~ ' ' -}} [/ROLE]
  {%- endif -%}
{%- endfor -%}
"""
#: Code points of a part of a conversation; a turn is never cut.
PART = 1_000_000
#: Code points and rows of one Arrow batch of output.
_BATCH, _ROWS = 4_000_000, 1000
_PARTS = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("last", pa.bool_()), ("text", pa.string()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])
_TURN = re.compile(r"\[INST\] (?P<user>.*?) \[/INST\]| (?P<assistant>.*?)</s>|\[ROLE\] (?P<role>.*?) \[TEXT\] (?P<text>.*?) \[/ROLE\]", re.DOTALL)


def compiled(source: str = TEMPLATE, controls: list[str] = CONTROLS) -> Template:
    return Template(source, {"escape": Escaper(controls).escape})


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn of a text that ``TEMPLATE`` has formatted."""
    at = 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if found is None:
            raise ValueError(f"no turn at {at}: {formatted[at : at + 40]!r}")
        kind = found.lastgroup
        role = Escaper.unescape(found["role"]) if kind == "text" else kind
        yield role, Escaper.unescape(found[kind])
        at = found.end()


def _sorted_rows(batches, *names: str):
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names))


def _parts(pieces) -> Iterator[tuple[str, list[int], list[int], bool]]:
    """Pieces of a rendering as parts (text, starts, ends, last): spans count
    from the part's own start, an empty piece at the end opens no part."""
    texts, starts, ends, size, before = [], [], [], 0, 0
    for text, a, b in pieces:
        if size >= PART and text:
            yield "".join(texts), starts, ends, False
            texts, starts, ends, before, size = [], [], [], before + size, 0
        texts.append(text)
        starts += [x - before for x in a]
        ends += [x - before for x in b]
        size += len(text)
    yield "".join(texts), starts, ends, True


def format_conversations(rows: DataFrame, source: str = TEMPLATE, controls: list[str] = CONTROLS) -> DataFrame:
    """conv_id, part, last, text, starts, ends: the formatted conversations in
    parts, and the spans of each part that a model is trained on."""
    bound_batches(rows.sparkSession)
    compiled(source, controls)  # errors in a template appear here, not in a task
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches):
        template = compiled(source, controls)
        out, size = [], 0
        for key, group in groupby(_sorted_rows(batches, "conv_id", "role", "text"), key=lambda r: r[0]):
            messages = ({"role": role, "text": text} for _, role, text in group)
            for n, (text, starts, ends, last) in enumerate(_parts(template.pieces(messages=messages))):
                out.append((key, n, last, text, starts, ends))
                size += len(text)
                if size >= _BATCH or len(out) >= _ROWS:
                    yield _batch(out)
                    out, size = [], 0
        if out:
            yield _batch(out)
        give_back()

    return dealt.mapInArrow(run, "conv_id long, part long, last boolean, text string, starts array<long>, ends array<long>")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PARTS)], schema=_PARTS)


def digests(parts: DataFrame) -> DataFrame:
    """The counts and hashes of formatted conversations, from their parts.
    Conversations of one part need no shuffle."""

    def run(batches):
        done = []
        for key, group in groupby(_sorted_rows(batches, "conv_id", "part", "text", "starts", "ends"), key=lambda r: r[0]):
            turns, loss, n_turns, n_loss, size, expected = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0
            for _, part, text, starts, ends in group:
                if part != expected:
                    raise ValueError(f"part {expected} of conversation {key} is missing")
                expected += 1
                for role, said in read_turns(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    n_turns += 1
                for a, b in zip(starts, ends):
                    said = Escaper.unescape(text[a:b])
                    loss.update(said.encode())
                    n_loss += len(said)
                size += len(text)
            done.append((key, n_turns, turns.hexdigest(), n_loss, loss.hexdigest(), size))
            if len(done) >= _ROWS:
                yield table_of(done)
                done = []
        if done:
            yield table_of(done)
        give_back()

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def table_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    columns = ["conv_id", "part", "text", "starts", "ends"]
    whole = parts.where("part = 0 AND last").select(*columns)
    cut = parts.where("NOT (part = 0 AND last)").select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return whole.mapInArrow(run, schema).unionByName(cut.mapInArrow(run, schema))


#: A conversation that says the marks of the template itself.
PLANTED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame(PLANTED, "conv_id long, turn long, role string, text string")
    return digests(store(format_conversations(rows.unionByName(planted)), "formatted"))


#: DuckDB SQL of the query.
ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, 2 * length(text) - length(replace(text, '\', '')) + len(regexp_extract_all(text, '</?s>|\[/?INST\]|\[/?ROLE\]|\[TEXT\]')) AS t,
    2 * length(role) - length(replace(role, '\', '')) + len(regexp_extract_all(role, '</?s>|\[/?INST\]|\[/?ROLE\]|\[TEXT\]')) AS r
  FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE role WHEN 'user' THEN 15 + t WHEN 'assistant' THEN 5 + t ELSE 23 + r + t END) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
