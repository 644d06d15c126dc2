"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns up to it, formatted, with only that reply under the
loss mask. Turns are marked `<|im_start|>role\\ntext<|im_end|>\\n`. Control strings inside roles and texts, of this
template and of other common ones, get a backslash after their first character, and one more where they already
have some; reading back takes one away, so every text returns as it was. A conversation that doesn't end with an
assistant turn gives one more row, without a loss span, so that no turn is lost.

Rows are dealt by conversation and sorted within partitions; a task streams them and holds one conversation's
prefix at a time. Defined cases: null roles and texts are empty; turns come by number, nulls first, and rows with
equal numbers by role and text; repeated rows are turns of their own; rows without an id are one conversation; an
empty table gives an empty one; other columns are not read.
"""

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BEGIN, BREAK, END = "<|im_start|>", "\n", "<|im_end|>\n"
#: control strings by first character and rest
_ANGLE = r"\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|startoftext\|>|s>|/s>|<SYS>>|</SYS>>"
_CONTROL = re.compile(rf"(<)(\\*)({_ANGLE})|(\[)(\\*)(/?INST\])")
_ESCAPED = re.compile(rf"(<)\\(\\*)({_ANGLE})|(\[)\\(\\*)(/?INST\])")
#: characters of formatted text in one output batch
BATCH = 4_000_000

EXAMPLES = "conv_id long, example long, text string, loss_start long, loss_end long"
_EXAMPLES = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("text", pa.string()),
                       ("loss_start", pa.int64()), ("loss_end", pa.int64())])
DIGESTS = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
           "formatted_chars long, n_examples long")
_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                      ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
                      ("n_examples", pa.int64())])


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: (m[1] or m[4]) + "\\" + (m[2] or m[5] or "") + (m[3] or m[6]), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: (m[1] or m[4]) + (m[2] or m[5] or "") + (m[3] or m[6]), text)


def _role(role: str) -> str:
    """A role has no line break of its own in the output."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_back(shown: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(shown), flags=re.S)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The marked turn and where its text begins and ends in it."""
    head = BEGIN + _role(role) + BREAK
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


def read_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    turns = []
    for part in text.split(BEGIN)[1:]:
        role, _, body = part.partition(BREAK)
        turns.append((_role_back(role), unescape(body[:-len(END)])))
    return turns


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batched(rows: Iterator[tuple], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += size(row)
        if chars > BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)


def _expanded(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows of (conv_id, role, text), sorted by conversation and turn."""
    def rest():
        if pieces and not spoken:
            yield now, n, "".join(pieces), None, None

    now, pieces, size, n, spoken = None, [], 0, 0, True
    for conv, role, text in rows:
        if conv != now:
            yield from rest()
            now, pieces, size, n = conv, [], 0, 0
        shown, start, end = format_turn(role or "", text or "")
        pieces.append(shown)
        spoken = role == "assistant"
        if spoken:
            pieces = ["".join(pieces)]
            yield conv, n, pieces[0], size + start, size + end
            n += 1
        size += len(shown)
    yield from rest()


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _batched(_expanded(_rows(batches)), _EXAMPLES, lambda row: len(row[2]))


def _folded(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Digests of each conversation; its examples follow each other."""
    def close():
        turns = read_turns(last)
        shown = "".join([f"{role}\n{text}\n" for role, text in turns])
        yield (now, len(turns), hashlib.sha256(shown.encode()).hexdigest(), chars, loss.hexdigest(), formatted, n)

    now, last, loss, chars, formatted, n = None, None, None, 0, 0, 0
    for conv, example, text, start, end in rows:
        if last is None or conv != now:
            if last is not None:
                yield from close()
            now, loss, chars, formatted, n = conv, hashlib.sha256(), 0, 0, 0
        if example != n:
            raise ValueError("the rows are not in the order of `examples`; read them with ordered=False")
        if start is not None:
            reply = unescape(text[start:end])
            loss.update(reply.encode())
            chars += len(reply)
        last, formatted, n = text, formatted + len(text), n + 1
    if last is not None:
        yield from close()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _batched(_folded(_rows(batches)), _DIGESTS, lambda row: 500)


def examples(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
             text: str = "text") -> DataFrame:
    """conv_id, example, text, and the loss span [loss_start, loss_end) in characters; null without a reply."""
    rows = turns.select(F.col(conv_id).cast("long").alias("c"), F.col(role).cast("string").alias("r"),
                        F.col(text).cast("string").alias("t"), F.col(turn).alias("n"))
    rows = rows.repartition("c").sortWithinPartitions("c", "n", "r", "t")
    return rows.select("c", "r", "t").mapInArrow(_examples, EXAMPLES)


def digests(formatted: DataFrame, ordered: bool = True) -> DataFrame:
    """What is read back from the output of `examples`.

    Its rows come in order and need no shuffle; rows that have been written or dealt anew are sorted with
    `ordered=False`, and refused without it.
    """
    rows = formatted.select("conv_id", "example", "text", "loss_start", "loss_end")
    if not ordered:
        rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "example")
    return rows.mapInArrow(_digests, DIGESTS)
