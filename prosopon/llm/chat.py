r"""Chat formatting by schema fingerprints.

A record is a JSON object in any layout. The set of its nested field paths (`messages[].role`), as far as some mapping knows them, is
hashed; the hash selects a declarative mapping, the first one whose required paths all occur, which yields canonical turns of role and text. The template then writes
`<|turn|>role\ntext<|end|>\n` per turn. Inside roles and texts the first character of every control string, and every backslash, is written as
a backslash and a letter, so no control string of this or the other usual templates survives there, and `read_back` restores every
turn. The loss mask is the list of spans (code points of the formatted text) of the assistant's texts.

Defined results: null texts and roles are empty; a record that is null, no JSON object, nested too deep for JSON, or of a layout that no mapping
knows gives null in every column but the fingerprint; a record without turns gives the empty text; fields that the mapping does not know are
ignored, and so are elements of a list of turns that are no objects or have neither role nor text; a text that is a list of parts
gives the parts' texts, one per line; half a surrogate pair becomes U+FFFD; a record of text alone is one turn of the assistant; other
columns are kept, and those named like a result column are replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosopon.llm.common import map_batches

TURN, END = "<|turn|>", "<|end|>"
#: Control strings of the usual templates; "<|" and "|>" stand for all of that form, the template's own included.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Letters that stand for a character after a backslash.
CODES = {"\\": "\\", "<": "l", "[": "b", "|": "p", "\n": "n"}
CODED_NEWLINE = "\\n"
DECODES = {v: k for k, v in CODES.items()}
STARTS = re.compile(r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
CODED = re.compile(r"\\(.)", re.S)
#: Half of a character beyond 16 bits, which JSON can name but no UTF-8 text can hold.
SURROGATE = re.compile("[\ud800-\udfff]")
WRITTEN = re.compile(re.escape(TURN) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)
#: Other names of the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Turn:
    """One turn, or one per element of the array `each`; texts are joined by a blank line, missing ones left out."""

    role: str  # a literal, or a path below `each`
    texts: tuple[str, ...]
    each: str = ""
    named: bool = False  # the role's value goes through ROLES


@dataclass(frozen=True)
class Mapping:
    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...]
    turns: tuple[Turn, ...]


SYSTEM = Turn("system", ("system",))
#: In order: the first one counts whose required paths all occur. Paths are written with dots here and compared field by field.
MAPPINGS = (
    Mapping("messages", ("messages[].role", "messages[].content"), ("system",), (SYSTEM, Turn("role", ("content",), "messages"))),
    Mapping("messages, from and value", ("messages[].from", "messages[].value"), ("system",), (SYSTEM, Turn("from", ("value",), "messages", True))),
    Mapping("from and value", ("conversations[].from", "conversations[].value"), ("system",), (SYSTEM, Turn("from", ("value",), "conversations", True))),
    Mapping("conversations", ("conversations[].role", "conversations[].content"), ("system",), (SYSTEM, Turn("role", ("content",), "conversations"))),
    Mapping("prompt", ("prompt", "completion"), ("system",), (SYSTEM, Turn("user", ("prompt",)), Turn("assistant", ("completion",)))),
    Mapping("prompt and response", ("prompt", "response"), ("system",), (SYSTEM, Turn("user", ("prompt",)), Turn("assistant", ("response",)))),
    Mapping("instruction", ("instruction", "output"), ("input", "system"), (SYSTEM, Turn("user", ("instruction", "input")), Turn("assistant", ("output",)))),
    Mapping("instruction and response", ("instruction", "response"), ("input", "context", "system"), (SYSTEM, Turn("user", ("instruction", "input", "context")), Turn("assistant", ("response",)))),
    Mapping("question", ("question", "answer"), ("context", "system"), (SYSTEM, Turn("user", ("context", "question")), Turn("assistant", ("answer",)))),
    Mapping("no messages", ("messages[]",), ("system",), (SYSTEM,)),
    Mapping("no conversations", ("conversations[]",), ("system",), (SYSTEM,)),
    Mapping("text", ("text",), (), (Turn("assistant", ("text",)),)),
)
Path = tuple[str, ...]


def path(written: str) -> Path:
    return tuple(part for field in written.split(".") for part in ((field[:-2], "[]") if field.endswith("[]") else (field,)))


REQUIRED = [(m, {path(p) for p in m.required}) for m in MAPPINGS]
KNOWN = {path(p): p for m in MAPPINGS for p in m.required + m.optional}
#: No known path is longer, so nothing below is looked at, however deep a record is.
DEEPEST = max(map(len, KNOWN))


def paths(value, at: Path = ()) -> set[Path]:
    """Paths of the leaves down to DEEPEST; `[]` stands for an array's elements, and an empty array or object is a leaf."""
    if len(at) < DEEPEST and isinstance(value, dict) and value:
        return set().union(*(paths(v, (*at, k)) for k, v in value.items()))
    if len(at) < DEEPEST and isinstance(value, list):
        return set().union(*(paths(v, (*at, "[]")) for v in value)) if value else {(*at, "[]")}
    return {at}


def known_paths(record: dict) -> set[Path]:
    """The known paths of a record. A path that leads to more, such as `content` with parts, counts as well."""
    found = paths(record)
    return {p[:n] for p in found for n in range(1, len(p) + 1)} & KNOWN.keys() - {p for p in KNOWN if p[-1] == "[]" and p not in found}


def fingerprint(found: set[Path]) -> str:
    return hashlib.sha256("\n".join(sorted(KNOWN[p] for p in found)).encode()).hexdigest()[:16]


def selected(found: set[Path], memo: dict[str, Mapping | None]) -> tuple[str, Mapping | None]:
    """The fingerprint of known paths and the mapping that it stands for, None for none; worked out once per fingerprint."""
    print_ = fingerprint(found)
    if print_ not in memo:
        memo[print_] = next((m for m, required in REQUIRED if required <= found), None)
    return print_, memo[print_]


def as_text(value) -> str:
    """Texts as they are; of a list of parts the texts, one per line; everything else as JSON."""
    if isinstance(value, list) and value and all(isinstance(v, str) or (isinstance(v, dict) and isinstance(v.get("text"), str)) for v in value):
        return "\n".join(as_text(v if isinstance(v, str) else v["text"]) for v in value)
    text = "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return SURROGATE.sub("\ufffd", text)


def turns_of(record: dict, mapping: Mapping) -> list[tuple[str, str]]:
    found = []
    for turn in mapping.turns:
        for item in record[turn.each] if turn.each else [record]:
            if not isinstance(item, dict) or (turn.each and turn.role not in item and not any(t in item for t in turn.texts)):
                continue
            present = [as_text(item.get(t)) for t in turn.texts if t in item]
            if turn.each:
                role = as_text(item.get(turn.role))
                found.append((ROLES.get(role, role) if turn.named else role, "\n\n".join(present)))
            elif present:
                found.append((turn.role, "\n\n".join(present)))
    return found


def escape(text: str) -> str:
    return STARTS.sub(lambda m: "\\" + CODES[m.group()], text)


def unescape(text: str) -> str:
    return CODED.sub(lambda m: DECODES[m.group(1)], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the loss mask."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role).replace(chr(10), CODED_NEWLINE)}\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(role), unescape(text)) for role, text in WRITTEN.findall(formatted)]


def parsed(record: str | None):
    try:
        value = json.loads(record) if record is not None else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def formatted(records: DataFrame, record: str = "record") -> DataFrame:
    """`records` with schema_fingerprint, mapping, formatted and loss_spans."""

    def written(value: dict, mapping: Mapping | None):
        try:
            return render(turns_of(value, mapping)) if mapping else (None, None)
        except RecursionError:  # a value too deep to write as JSON
            return None, None

    def work(batches):
        memo: dict[str, Mapping | None] = {}
        for batch in batches:
            rows = []
            for text in batch.column(record).to_pylist():
                value = parsed(text)
                print_, mapping = selected(known_paths(value), memo) if value is not None else (None, None)
                out, spans = written(value, mapping)
                rows.append((print_, mapping and mapping.name, out, None if spans is None else [{"start": a, "end": b} for a, b in spans]))
            yield batch, [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 4

    return map_batches(records, work, "schema_fingerprint string, mapping string, formatted string, loss_spans array<struct<start:int,end:int>>")


def digests(chats: DataFrame) -> DataFrame:
    """`chats` with figures read back from the formatted text and the mask alone."""

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def work(batches):
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist(), strict=True):
                if text is None:
                    rows.append((None,) * 5)
                    continue
                turns = read_back(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            yield batch, [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 5

    return map_batches(chats, work, "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def records_of(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conversation, record): one JSON record per conversation from a table with a row per turn.

    A conversation that is one prompt and one answer, with or without a system text, takes the prompt layout, any other the message
    layout. Turns are in order of `turn`, nulls first, equal turns by role and text. A conversation is one record, so its
    rows meet in one task.
    """
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    grouped = rows.groupBy(F.col(conv_id).alias("conversation")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    roles = F.array_join("turns.role", "|")
    said = lambda k: F.get("turns.content", F.lit(k))
    record = (
        F.when(roles == "user|assistant", F.to_json(F.struct(said(0).alias("prompt"), said(1).alias("completion"))))
        .when(roles == "system|user|assistant", F.to_json(F.struct(said(0).alias("system"), said(1).alias("prompt"), said(2).alias("completion"))))
        .otherwise(F.to_json(F.struct(F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages"))))
    )
    return grouped.select("conversation", record.alias("record"))
