"""Chat formatting in budgeted windows.

The turns of a conversation follow one another in training windows of at most ``budget`` tokens.  A running sum of turn tokens says
where a window ends: always between turns.  Each window starts with the conversation's system turn and as many of the
last turns before it as fit into ``history`` tokens; both are repeated context.  History gives way to the system turn.  A system turn
of more than half the budget is left out of a window whose first new turn fits beside it no more (in the first window it then
stands alone), and one longer than the budget is a plain first turn, not repeated.  Loss falls on assistant texts that
are not repeated, so every assistant text is a target once.  A turn longer than the budget has a window of its own.

Turns are written <|im_start|>role, newline, text, <|im_end|>, newline.  Inside roles and texts every ``<|`` becomes ``<||``, and a newline in a role
becomes ``<|n|>``; this is reversible and leaves no control string in them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import chosen
from claimloom.llm.tokens import byte_pairs

START, END = "<|im_start|>", "<|im_end|>"
BUDGET, HISTORY = 1024, 256
WINDOW = "window bigint, context_turns bigint, tokens bigint, text string, loss array<bigint>"


def escape(text: str) -> str:
    return text.replace("<|", "<||")


def unescape(text: str) -> str:
    return text.replace("<||", "<|")


def turn_text(role: str, text: str) -> str:
    name = escape(role).replace("\n", "<|n|>")
    return f"{START}{name}\n{escape(text)}{END}\n"


def read_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a window."""
    out = []
    for part in text.split(START)[1:]:
        role, _, rest = part.partition("\n")
        out.append((unescape(role.replace("<|n|>", "\n")), unescape(rest[:-len(END) - 1])))
    return out


def windows_of(turns: Iterator[tuple[str, str]], count, budget: int, history: int) -> Iterator[tuple[int, int, str, list[int]]]:
    """(context turns, tokens, text, loss spans) of one conversation; keeps one window and its history in memory."""
    system: list[tuple[str, int, bool]] = []
    head: list[tuple[str, int, bool]] = []  # the system turn, in windows that have it
    made = 0
    recent: list[tuple[str, int, bool]] = []
    new: list[tuple[str, int, bool]] = []
    running = opened = 0  # prefix sums of turn tokens: so far, and where the window's new turns began

    def closed():
        context = head + recent
        text, loss = "".join(t for t, _, _ in context), []
        for turn, _, target in new:
            if target:
                loss += [len(text) + turn.index("\n") + 1, len(text) + len(turn) - len(END) - 1]
            text += turn
        return len(context), sum(n for _, n, _ in context + new), text, loss

    for i, (role, said) in enumerate(turns):
        turn = turn_text(role, said)
        size, is_system = count(turn), i == 0 and role == "system"
        fixed = sum(n for _, n, _ in head + recent)
        if new and fixed + running + size - opened > budget:
            yield closed()
            made += 1
            recent = _last(recent + new, history)
            new, opened = [], running
        if not new:  # a window begins
            beside = not system or system[0][1] <= max(budget // 2, budget - size)
            if not (beside or made):
                yield closed()
                made += 1
            head = system if beside else []
            while recent and sum(n for _, n, _ in head + recent) + size > budget:
                recent = recent[1:]
        running += size
        if is_system and size <= budget:
            system = head = [(turn, size, False)]
            opened = running
            continue
        new.append((turn, size, role == "assistant"))
    if new or system:
        yield closed()


def _last(turns: list[tuple[str, int, bool]], history: int) -> list[tuple[str, int, bool]]:
    size, out = 0, []
    for turn in reversed(turns):
        size += turn[1]
        if size > history:
            break
        out.insert(0, turn)
    return out


def format_chats(chats: DataFrame, rank_file: str, pattern: str, budget: int = BUDGET, history: int = HISTORY, id_col: str = "conv_id",
                 turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, window, context_turns, tokens, text, loss) of every conversation.

    ``loss`` lists starts and ends of the target texts inside ``text``, in characters.  Null roles and texts are empty; null turns come first;
    turns with equal numbers follow role and text; repeated rows are turns each; rows without conv_id are one conversation.
    Long conversations are streamed: a task holds one window, never a whole conversation.  Windows of a conversation follow
    each other within a partition.  An empty table gives an empty result; further columns are ignored.
    """
    kind = chats.schema[id_col].dataType.simpleString()

    def work(batches):
        pairs = byte_pairs(rank_file, pattern)
        id_type = None

        def all_rows():
            nonlocal id_type
            for b in batches:
                id_type = b.schema.field(0).type
                yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())

        rows = all_rows()
        ahead = next(rows, None)
        out, held = [], 0
        while ahead is not None:
            conv = ahead[0]

            def turns():
                nonlocal ahead
                while ahead is not None and ahead[0] == conv:
                    row, ahead = ahead, next(rows, None)
                    yield row[1] or "", row[2] or ""

            for k, (context, tokens, text, loss) in enumerate(windows_of(turns(), lambda t: len(pairs.encode(t)), budget, history)):
                out.append((conv, k, context, tokens, text, loss))
                held += len(text)
                if held > 1 << 21:
                    yield _batch(out, fields, id_type)
                    out, held = [], 0
        if out:
            yield _batch(out, fields, id_type)

    dealt = (chosen(chats, conv_id=id_col, turn=turn_col, role=role_col, text=text_col)
             .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text"))
    fields = ["conv_id", "window", "context_turns", "tokens", "text", "loss"]
    return dealt.mapInArrow(work, f"conv_id {kind}, {WINDOW}")


def _batch(rows: list[tuple], names: list[str], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = [id_type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read from windows in their order."""
    def work(batches):
        now = None  # conv, turns, hash of turns, loss characters, hash of loss, characters

        def row():
            return (now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5])

        def rows_of(rows):
            kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                              names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for b in batches:
            out, id_type = [], b.schema.field(0).type
            for conv, k, context, text, loss in zip(*[b.column(i).to_pylist() for i in range(5)]):
                if now is None or k == 0:
                    if now is not None:
                        out.append(row())
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns = read_turns(text)
                fresh = turns[context:] if k else turns
                now[1] += len(fresh)
                for role, said in fresh:
                    now[2].update(f"{role}\n{said}\n".encode())
                for start, end in zip(loss[::2], loss[1::2]):
                    said = unescape(text[start:end])
                    now[3] += len(said)
                    now[4].update(said.encode())
                now[5] += len(text)
            if out:
                yield rows_of(out)
        if now is not None:
            yield rows_of([row()])

    kind = windows.schema["conv_id"].dataType.simpleString()
    return windows.select("conv_id", "window", "context_turns", "text", "loss").mapInArrow(
        work, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
