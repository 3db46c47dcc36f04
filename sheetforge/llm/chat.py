"""Chat formatting: heterogeneous layouts to canonical turns, and turns to one template.

A record's *fingerprint* is a hash of its nested field paths. It selects a declarative mapping from LAYOUTS;
records of a new shape need a new entry there, no code. The template marks each turn and escapes control
strings inside texts by one backslash behind their first character, which can be undone exactly.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"

# An opening character, any number of backslashes, and what makes it a control string: <|...|>, <s>, </s>,
# [INST], [/INST], <<SYS>>, <</SYS>>. Escaping adds one backslash, unescaping takes one away.
_REST = r"(?=\||/?s>|/?INST\]|</?SYS>>)"
_CONTROL = r"([<\[])(\\*)" + _REST
_ESCAPED = re.compile(r"([<\[])\\(\\*)" + _REST)

#: name -> paths of the layout (without the record id), and how to read turns from it. "each": a list
#: of messages with the fields of role and text; "sequence": (role, fields joined by a blank line) in order;
#: "row": the record is a single turn.
LAYOUTS: dict[str, dict] = {
    "turn_rows": {"paths": ["role", "text", "turn"], "row": ("turn", "role", "text")},
    "messages": {"paths": ["messages[].role", "messages[].content"], "each": ("messages", "role", "content")},
    "from_value": {"paths": ["conversations[].from", "conversations[].value"], "each": ("conversations", "from", "value")},
    "instruction_input": {"paths": ["instruction", "input", "output"], "sequence": [("user", ["instruction", "input"]), ("assistant", ["output"])]},
    "instruction": {"paths": ["instruction", "output"], "sequence": [("user", ["instruction"]), ("assistant", ["output"])]},
    "prompt_completion": {"paths": ["prompt", "completion"], "sequence": [("user", ["prompt"]), ("assistant", ["completion"])]},
    "prompt_response": {"paths": ["prompt", "response"], "sequence": [("user", ["prompt"]), ("assistant", ["response"])]},
    "system_prompt_response": {"paths": ["prompt", "response", "system"], "sequence": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])]},
    "question_answer": {"paths": ["question", "answer"], "sequence": [("user", ["question"]), ("assistant", ["answer"])]},
}
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint(paths: list[str]) -> str:
    """Hash of a set of nested field paths."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode("utf-8", "surrogatepass")).hexdigest()[:16]


def _step(at: str, name: str) -> str:
    """The path ``at`` with a field behind it; dots and brackets within a name are escaped, so they never look like structure."""
    name = re.sub(r"[\\.\[\]]", lambda m: "\\" + m[0], name)
    return f"{at}.{name}" if at else name


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a Spark type; a list adds []."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, _step(at, f.name))]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, at + "[]")
    return [at]


def value_paths(value: object, at: str = "") -> list[str]:
    """Nested field paths of a JSON value; empty lists and nulls are leaves."""
    if isinstance(value, dict) and value:
        return [p for k, v in value.items() for p in value_paths(v, _step(at, k))]
    if isinstance(value, list) and value:
        return [p for v in value for p in value_paths(v, at + "[]")]
    return [at]


_BY_PRINT = {fingerprint(x["paths"]): name for name, x in LAYOUTS.items()}


def layout_of(paths: list[str]) -> str | None:
    """Layout with this very fingerprint, or else the one with most paths among those that ``paths`` covers."""
    if exact := _BY_PRINT.get(fingerprint(paths)):
        return exact
    have = set(paths)
    fit = [(len(x["paths"]), name) for name, x in LAYOUTS.items() if have.issuperset(x["paths"])]
    return max(fit)[1] if fit else None


def _role(role: Column) -> Column:
    out = F.coalesce(role, F.lit(""))
    for old, new in ROLES.items():
        out = F.when(role == old, new).otherwise(out)
    return out


def canonical_turns(records: DataFrame, id_col: str) -> DataFrame:
    """(conv_id, turn, role, text) of typed records; the mapping is chosen by the schema's fingerprint.

    Null texts become empty, null roles the empty role, extra columns are ignored, a null list gives
    no turn. Raises ValueError when no layout fits the schema.
    """
    paths = schema_paths(T.StructType([f for f in records.schema.fields if f.name != id_col]))
    name = layout_of(paths)
    if name is None:
        raise ValueError(f"no layout for fingerprint {fingerprint(paths)}: {sorted(paths)}")
    spec, key = LAYOUTS[name], F.col(id_col).alias("conv_id")
    if "row" in spec:
        turn, role, text = spec["row"]
        return records.select(key, F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if "each" in spec:
        items, role, text = spec["each"]
        rows = records.select(key, F.posexplode(items).alias("turn", "m"))
        return rows.select("conv_id", F.col("turn").cast("long"), _role(F.col("m")[role]).alias("role"), F.coalesce(F.col("m")[text], F.lit("")).alias("text"))
    steps = [F.struct(F.lit(role).alias("role"), F.array_join(F.filter(F.array(*fields), lambda x: x != ""), "\n\n").alias("text")) for role, fields in spec["sequence"]]
    rows = records.select(key, F.posexplode(F.array(*steps)).alias("turn", "m"))
    return rows.select("conv_id", F.col("turn").cast("long"), F.col("m.role"), F.coalesce("m.text", F.lit("")).alias("text"))


def _clean(value: object) -> str:
    """Text of a JSON value: empty for null, JSON for lists and objects; halves of surrogate pairs become the replacement sign."""
    text = "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _record_turns(raw: str | None) -> tuple[str, str | None, list[tuple[int | None, str | None, str | None]]]:
    """(fingerprint, layout, turns) of one JSON record; layout None where it can't be read by any."""
    paths: list[str] = []
    try:
        value = json.loads(raw) if raw else None
        paths = value_paths(value) if isinstance(value, dict) else []
        name = layout_of(paths)
        if name is not None:
            spec = LAYOUTS[name]
            if "row" in spec:
                turn, role, text = (value[f] for f in spec["row"])
                if isinstance(turn, bool) or not isinstance(turn, (int, str)) or not -(1 << 63) <= int(turn) < 1 << 63:
                    raise ValueError(turn)
                turns = [(int(turn), role, text)]
            elif "each" in spec:
                items, role, text = spec["each"]
                if not all(isinstance(m, dict) for m in value[items]):
                    raise ValueError(items)
                turns = [(i, ROLES.get(m.get(role), m.get(role)) if isinstance(m.get(role), str) else m.get(role), m.get(text)) for i, m in enumerate(value[items])]
            else:
                turns = [(i, role, "\n\n".join(_clean(value[f]) for f in fields if value[f] not in (None, ""))) for i, (role, fields) in enumerate(spec["sequence"])]
            return fingerprint(paths), name, [(turn, _clean(role), _clean(text)) for turn, role, text in turns]
    except (ValueError, TypeError, KeyError, RecursionError):
        pass
    return fingerprint([_clean(p) for p in paths]), None, [(None, None, None)]


def canonical_turns_json(records: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(conv_id, fingerprint, layout, turn, role, text) of JSON records that may differ from row to row.

    A record that is no JSON object, fits no layout or strays from its layout (a list with items that aren't objects, a turn that
    is no whole number, nesting beyond what can be read) gives one row with null layout, turn, role and text. Texts that aren't strings become their
    JSON. Roles of message lists are mapped by ROLES, those of the row layout are kept as they are. Repeated rows are kept; an empty
    table gives an empty result.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, raw in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                digest, name, turns = _record_turns(raw)
                out += [(key, digest, name, *turn) for turn in turns]
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [batch.schema.field(0).type, pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "fingerprint", "layout", "turn", "role", "text"])

    kind = records.schema[id_col].dataType.simpleString()
    return records.select(id_col, json_col).mapInArrow(read, f"conv_id {kind}, fingerprint string, layout string, turn long, role string, text string")


def format_turns(turns: DataFrame) -> DataFrame:
    """``turns`` plus formatted, loss_begin and loss_end (code points within formatted).

    A conversation's formatted text is the concatenation of its turns' formatted texts in the order of
    (turn, role, text). The loss mask covers the escaped text of assistant turns; it is empty for the others.
    Very long conversations stay rows, so none has to fit one task. Columns called formatted, loss_begin or loss_end are replaced;
    null roles and texts are empty; repeated rows are kept.
    """
    role = F.replace(F.replace(F.coalesce("role", F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    escaped = F.regexp_replace(F.coalesce("text", F.lit("")), _CONTROL, r"$1$2\\")
    head = F.concat(F.lit(START), F.regexp_replace(role, _CONTROL, r"$1$2\\"), F.lit("\n"))
    begin = F.length(head)
    end = begin + F.when(F.col("role") == "assistant", F.length(escaped)).otherwise(0)
    kept = [c for c in turns.columns if c.lower() not in ("formatted", "loss_begin", "loss_end")]
    return turns.select(*kept, F.concat(head, escaped, F.lit(END + "\n")).alias("formatted"), begin.alias("loss_begin"), end.alias("loss_end"))


def unescape(text: str) -> str:
    """Undoes the escaping of control strings."""
    return _ESCAPED.sub(r"\1\2", text)


def parse_turn(formatted: str) -> tuple[str, str]:
    """(role, text) of one formatted turn."""
    head, _, body = formatted[len(START) : -len(END) - 1].partition("\n")
    role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(head))
    return role, unescape(body)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of conversations, read from formatted turns (conv_id, turn, formatted, loss_begin, loss_end).

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars). Rows are dealt by ranges of
    conv_id and sorted; a task streams over them with two running hashes, so a conversation of any length needs
    no memory of its own. A null conv_id is a conversation like any other.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, now, state = None, None, None

        def row() -> pa.RecordBatch:
            n, all_turns, chars, loss, total = state
            values = [now[0], n, all_turns.hexdigest(), chars, loss.hexdigest(), total]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kind, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            kind = kind or [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            done = []
            for key, text, begin, end in zip(*(batch[i].to_pylist() for i in range(4)), strict=True):
                if now != (key,):
                    if now is not None:
                        done.append(row())
                    now, state = (key,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, said = parse_turn(text)
                masked = unescape(text[begin:end])
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                state[2] += len(masked)
                state[3].update(masked.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if now is not None:
            yield row()

    key = formatted.schema["conv_id"].dataType.simpleString()
    dealt = formatted.select("conv_id", "turn", "formatted", "loss_begin", "loss_end").repartitionByRange("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return dealt.select("conv_id", "formatted", "loss_begin", "loss_end").mapInArrow(digest, f"conv_id {key}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
