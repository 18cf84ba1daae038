"""Chat formatting by schema fingerprints.

A record's nested field paths (``messages[].role``) are sorted and hashed; the hash selects one of the declared MAPPINGS,
which says where the turns of that layout are.  So prompt, instruction, message and row layouts all become canonical
turns (conv_id, turn, sub, role, text).  Records of an unknown layout give no turns; ``layouts`` counts them.

Each turn is formatted for itself, ``### role: text </turn>``, with the control characters of role and text escaped by a
backslash, and carries the span of its text if the text is to be learnt (assistant turns).  A conversation is the
concatenation of its turns by (turn, sub, role, text); no task ever holds a whole conversation, reading back included.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches

# Layout, its field paths, and its turns as (role, field) pairs or as a list of (list, role field, text field).
MAPPINGS = {
    "turn row": (["turn", "role", "text"], {"row": ("role", "text")}),
    "messages": (["messages[].role", "messages[].content"], {"list": ("messages", "role", "content")}),
    "from value": (["conversations[].from", "conversations[].value"], {"list": ("conversations", "from", "value")}),
    "prompt completion": (["prompt", "completion"], {"pairs": [("user", "prompt"), ("assistant", "completion")]}),
    "prompt response": (["prompt", "response"], {"pairs": [("user", "prompt"), ("assistant", "response")]}),
    "question answer": (["question", "answer"], {"pairs": [("user", "question"), ("assistant", "answer")]}),
    "instruction": (["instruction", "output"], {"pairs": [("user", "instruction"), ("assistant", "output")]}),
    "instruction input": (["instruction", "input", "output"], {"pairs": [("user", "instruction\n\ninput"), ("assistant", "output")]}),
    "system prompt response": (["system", "prompt", "response"], {"pairs": [("system", "system"), ("user", "prompt"), ("assistant", "response")]}),
}
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
IGNORED = ("id", "source", "metadata")  # top-level fields that do not make a layout
LEARNT = "assistant"
CONTROL = re.compile(r"([\\<#])")
IN_ROLE = re.compile(r"([\\<#:\n])")
LONE = re.compile("[\ud800-\udfff]")
TURN = re.compile(r"### ((?:[^\\<#:\n]|\\.)*): ((?:[^\\<#]|\\.)*) </turn>\n", re.S)


def paths(value, at: str = "") -> set[str]:
    if isinstance(value, dict):
        return {p for k, v in value.items() if at or k not in IGNORED for p in paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):  # plain values in a list have a path of their own, so they are no empty list
        return {p for v in value for p in (paths(v, f"{at}[]") if isinstance(v, (dict, list)) else (f"{at}[]=",))} or {f"{at}[]"}
    return {at}


def fingerprint(found: set[str]) -> str:
    return xxhash.xxh64_hexdigest("\n".join(sorted(found)).encode("utf-8", "surrogatepass"))


BY_FINGERPRINT = {fingerprint(set(fields)): name for name, (fields, _) in MAPPINGS.items()} | {
    fingerprint({"messages[]"}): "messages", fingerprint({"conversations[]"}): "from value"}  # empty lists


def _text(value) -> str:
    """A field as text: absent or null is empty, other values are their JSON; half a surrogate pair becomes U+FFFD."""
    text = "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return LONE.sub("\ufffd", text)


def _layout(record: str | None):
    """(fingerprint, layout, record) of a JSON record; no fingerprint if it is no object or nested too deeply to be read, no
    layout if none is declared for it or its turn is no 64-bit integer."""
    try:
        value = json.loads(record) if record is not None else None
        if not isinstance(value, dict):
            return None, None, None
        print_ = fingerprint(paths(value))
    except (ValueError, RecursionError):
        return None, None, None
    name = BY_FINGERPRINT.get(print_)
    if name == "turn row":
        turn = value["turn"]
        if turn is not None and (isinstance(turn, bool) or not isinstance(turn, int) or not -(1 << 63) <= turn < 1 << 63):
            name = None
    return print_, name, value


def _turns(record: dict, how: dict):
    """(role, text) of the record's turns."""
    if "row" in how:
        yield tuple(_text(record.get(f)) for f in how["row"])
    if "list" in how:
        name, role, text = how["list"]
        for m in record[name]:  # the fingerprint is that of all messages together: one of them may lack a field
            said = _text(m.get(role))
            yield ROLE_NAMES.get(said, said), _text(m.get(text))
    for role, fields in how.get("pairs", []):
        yield role, "\n\n".join(t for t in (_text(record.get(f)) for f in fields.split("\n\n")) if t)


def canonical_turns(records: DataFrame, id_col: str = "conv_id", record_col: str = "record") -> DataFrame:
    """(conv_id, turn, sub, role, text) from JSON records; a "turn row" record brings its own ``turn``, others have 0 and
    ``sub`` counts their turns.  Null and absent roles and texts are empty.  Null, broken or unknown records give none."""
    def run(batches):
        for b in batches:
            rows = []
            for i, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                _, name, record = _layout(r)
                if name:
                    turn = record["turn"] if name == "turn row" else 0
                    rows += [(i, turn, k, role, text) for k, (role, text) in enumerate(_turns(record, MAPPINGS[name][1]))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                    zip(*rows), [b.schema.types[0], pa.int64(), pa.int64(), pa.string(), pa.string()])],
                    names=["conv_id", "turn", "sub", "role", "text"])

    small_batches(records.sparkSession)
    id_type = records.schema[id_col].dataType.simpleString()
    return records.select(id_col, record_col).mapInArrow(run, f"conv_id {id_type}, turn bigint, sub bigint, role string, text string")


def layouts(records: DataFrame, record_col: str = "record") -> DataFrame:
    """(fingerprint, layout, n): records by schema fingerprint; layout is null if no mapping is declared for it or its turn is
    no integer.  Records that are no readable JSON object have no fingerprint."""
    def run(batches):
        for b in batches:
            found = [_layout(r)[:2] for r in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in (0, 1)], names=["fingerprint", "layout"])
    return records.select(record_col).mapInArrow(run, "fingerprint string, layout string").groupBy("fingerprint", "layout").agg(
        F.count("*").alias("n"))


def row_records(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, record) from a table of turns with columns turn, role and text."""
    return rows.select(F.col(id_col).alias("conv_id"), F.to_json(
        F.struct(F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")),
        {"ignoreNullFields": "false"}).alias("record"))


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, sub, formatted, loss_start, loss_end): the span, in characters of ``formatted``, to learn from;
    null for turns that are not learnt."""
    def run(batches):
        for b in batches:
            formatted, starts, ends = [], [], []
            for role, text in zip(b.column(3).to_pylist(), b.column(4).to_pylist()):
                head = "### " + IN_ROLE.sub(r"\\\1", role) + ": "
                body = CONTROL.sub(r"\\\1", text)
                formatted.append(head + body + " </turn>\n")
                starts.append(len(head) if role == LEARNT else None)
                ends.append(len(head) + len(body) if role == LEARNT else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(formatted, pa.string()),
                                              pa.array(starts, pa.int64()), pa.array(ends, pa.int64())],
                                             names=["conv_id", "turn", "sub", "formatted", "loss_start", "loss_end"])
    id_type = turns.schema["conv_id"].dataType.simpleString()
    return turns.select("conv_id", "turn", "sub", "role", "text").mapInArrow(
        run, f"conv_id {id_type}, turn bigint, sub bigint, formatted string, loss_start bigint, loss_end bigint")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and text of one formatted turn; an error if it is not exactly one."""
    m = TURN.fullmatch(formatted)
    if not m:
        raise ValueError(f"not a formatted turn: {formatted[:80]!r}")
    return unescape(m[1]), unescape(m[2])


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from the formatted turns: (conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars).  Turns stream through in order; a task keeps two running digests, no texts."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        current, state, ids = None, None, None

        def done(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*rows), [ids, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()])], names=names)

        def row():
            return current[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]
        for b in batches:
            ids, rows = b.schema.types[0], []
            for i, text, start, end in zip(*(b.column(k).to_pylist() for k in range(4))):
                if current != (i,):
                    if current:
                        rows.append(row())
                    current, state = (i,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, said = parse_turn(text)
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
                if start is not None:
                    learnt = unescape(text[start:end])
                    state[2] += len(learnt)
                    state[3].update(learnt.encode())
                state[4] += len(text)
            if rows:
                yield done(rows)
        if current:
            yield done([row()])

    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "sub", "formatted")
    id_type = formatted.schema["conv_id"].dataType.simpleString()
    return rows.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(
        run, f"conv_id {id_type}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
