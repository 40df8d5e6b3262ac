"""Chat formatting: layouts recognised by schema fingerprint, one reversible template.

A record in JSON is reduced to its set of nested field paths; the hash of that set selects a
declarative mapping from layout to canonical turns, so a new layout is a new table row and no
code. Turns are then written in a marked template whose control strings are escaped in texts, with
the spans of assistant text as loss mask, and can be read back exactly.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

START, END, ESCAPE = "<|im_start|>", "<|im_end|>", "\\"


def paths_of(value: object, at: str = "") -> set[str]:
    """Nested field paths of a JSON value; [] stands for any element."""
    if isinstance(value, dict):
        return set().union(*(paths_of(v, f"{at}.{k}") for k, v in value.items())) if value else {at}
    if isinstance(value, list):
        return set().union(*(paths_of(v, f"{at}[]") for v in value)) if value else {at + "[]"}
    return {at}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


#: Other names of the canonical roles in layouts that name speakers their own way.
SPEAKERS = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: Fixed layouts: field paths, and how turns are read. `each` walks a list of messages, whose roles
#: stand as they are but for those in `roles`; `fixed` lists (role, path) in order, of which an
#: empty `optional` one is no turn.
LAYOUTS = [
    {"paths": [".messages[].role", ".messages[].content"], "each": "messages", "role": "role", "text": "content"},
    {"paths": [".turns[].role", ".turns[].text"], "each": "turns", "role": "role", "text": "text"},
    {"paths": [".conversations[].from", ".conversations[].value"], "each": "conversations", "role": "from", "text": "value", "roles": SPEAKERS},
    {"paths": [".prompt", ".completion"], "fixed": [("user", "prompt"), ("assistant", "completion")]},
    {"paths": [".prompt", ".response"], "fixed": [("user", "prompt"), ("assistant", "response")]},
    {"paths": [".instruction", ".output"], "fixed": [("user", "instruction"), ("assistant", "output")]},
    {"paths": [".instruction", ".input", ".output"], "fixed": [("user", "instruction"), ("user", "input"), ("assistant", "output")], "optional": "input"},
    {"paths": [".system", ".prompt", ".completion"], "fixed": [("system", "system"), ("user", "prompt"), ("assistant", "completion")]},
    {"paths": [".question", ".answer"], "fixed": [("user", "question"), ("assistant", "answer")]},
]


def mapping_table() -> dict[str, dict]:
    return {fingerprint(set(x["paths"])): x for x in LAYOUTS}


def canonical_turns(record: dict, mappings: dict[str, dict]) -> list[tuple[str, str]] | None:
    """(role, text) in order; None for an unknown layout."""
    layout = mappings.get(fingerprint(paths_of(record)))
    if layout is None:
        return None
    if "each" in layout:
        found = [(x.get(layout["role"]), x.get(layout["text"])) for x in record[layout["each"]]]
    else:
        found = [(role, record[key]) for role, key in layout["fixed"] if key != layout.get("optional") or record[key]]
    roles = layout.get("roles", {})
    return [(roles.get(r, "" if r is None else str(r)), "" if t is None else str(t)) for r, t in found]


def escaped(text: str) -> str:
    """Control strings become harmless, and so do backslashes before them: \\ is \\\\ and <| is <\\|."""
    return text.replace(ESCAPE, ESCAPE * 2).replace("<|", "<" + ESCAPE + "|")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def formatted(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The template text and the spans of assistant texts in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        # a line end inside a role is escaped too: the first bare one ends the head
        head, body = START + escaped(role).replace("\n", ESCAPE + "\n") + "\n", escaped(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        piece = head + body + END + "\n"
        out.append(piece)
        at += len(piece)
    return "".join(out), spans


_TURN = re.compile(r"<\|im_start\|>((?:[^\\\n]|\\.)*)\n((?:[^\\<]|\\.|<(?!\|))*)<\|im_end\|>\n", re.S)


def read_back(text: str) -> list[tuple[str, str]]:
    """The turns of a template text; raises on anything that isn't one."""
    turns, at = [], 0
    while at < len(text):
        found = _TURN.match(text, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        turns.append((unescaped(found[1]), unescaped(found[2])))
        at = found.end()
    return turns


#: Turns of a conversation that go into one record at most.
TURNS = 64


def format_records(records: DataFrame) -> DataFrame:
    """id, run, runs, layout, text, loss_starts, loss_ends for records(id, record): record is JSON.

    `run` and `runs` number the records of one conversation; they are 0 and 1 where records has no
    such columns. An unknown layout, a null record or one that is no JSON object gives a null text
    and keeps its row; a null turn text is an empty one in every layout. Repeated rows get a row
    each; other columns are ignored.
    """
    mappings = mapping_table()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, part, parts, record in zip(frame["id"], frame["run"], frame["runs"], frame["record"], strict=True):
                try:
                    value = json.loads(record) if record is not None else None
                except ValueError:
                    value = None
                layout, turns = None, None
                if isinstance(value, dict):
                    layout, turns = fingerprint(paths_of(value)), canonical_turns(value, mappings)
                text, spans = (None, []) if turns is None else formatted(turns)
                rows.append((key, part, parts, layout, text, [a for a, _ in spans], [b for _, b in spans]))
            yield pd.DataFrame(rows, columns=["id", "run", "runs", "layout", "text", "loss_starts", "loss_ends"]).astype({"id": "Int64"})

    shape = "id long, run long, runs long, layout string, text string, loss_starts array<long>, loss_ends array<long>"
    numbers = [F.col(c).cast("long").alias(c) if c in records.columns else F.lit(x).cast("long").alias(c) for c, x in (("run", 0), ("runs", 1))]
    return records.select(F.col("id").cast("long").alias("id"), *numbers, F.col("record").cast("string").alias("record")).mapInPandas(run, shape)


def conversation_records(turns: DataFrame, most: int = TURNS) -> DataFrame:
    """id, run, runs and record of each run of at most `most` turns of turns(conv_id, turn, role, text).

    Turns go in the order of turn, then role and text where turns repeat; null roles and texts are
    empty. Runs are written in the layout that fits their roles: a prompt and its answer under one
    of four pairs of names, with or without a system text; three kinds of message lists for others.
    A long conversation is sorted with spilling and becomes many records, never one value.
    """
    said = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = Window.partitionBy("conv_id")
    place = F.row_number().over(whole.orderBy("turn", "role", "text")) - 1
    numbered = said.withColumns({"at": place, "turns": F.count("*").over(whole)}).withColumn("run", F.floor(F.col("at") / most))
    lists = numbered.groupBy("conv_id", "run").agg(F.max("turns").alias("turns"), F.array_sort(F.collect_list(F.struct("at", "role", "text"))).alias("said"))
    roles = F.transform("said", lambda x: x["role"])
    text = lambda i: F.col("said")[i]["text"]
    kind = F.pmod(F.xxhash64("conv_id", "run"), F.lit(12))

    def pair(a: str, b: str) -> Column:
        return F.to_json(F.struct(text(0).alias(a), text(1).alias(b)))

    def messages(name: str, role: str, content: str, speaker: Callable[[Column], Column] = lambda r: r) -> Column:
        each = F.transform("said", lambda x: F.struct(speaker(x["role"]).alias(role), x["text"].alias(content)))
        return F.to_json(F.struct(each.alias(name)))

    def renamed(role: Column) -> Column:
        return F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)

    asked = roles == F.array(F.lit("user"), F.lit("assistant"))
    led = roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))
    plain = ~F.exists(roles, lambda r: r.isin(*SPEAKERS))  # else the names of speakers would not come back
    record = (
        F.when(asked & (kind % 4 == 0), pair("prompt", "completion"))
        .when(asked & (kind % 4 == 1), pair("prompt", "response"))
        .when(asked & (kind % 4 == 2), pair("instruction", "output"))
        .when(asked, pair("question", "answer"))
        .when(led, F.to_json(F.struct(text(0).alias("system"), text(1).alias("prompt"), text(2).alias("completion"))))
        .when(plain & (kind % 3 == 0), messages("conversations", "from", "value", renamed))
        .when(kind % 3 == 1, messages("messages", "role", "content"))
        .otherwise(messages("turns", "role", "text"))
    )
    return lists.select(F.col("conv_id").alias("id"), "run", F.ceil(F.col("turns") / most).alias("runs"), record.alias("record"))


class _Digest:
    """Counts and digests of a conversation, run after run."""

    def __init__(self) -> None:
        self.turns = self.loss = self.size = 0
        self.said, self.learned, self.known = hashlib.sha256(), hashlib.sha256(), True

    def add(self, text: str | None, starts: list[int], ends: list[int]) -> None:
        if text is None:
            self.known = False
            return
        for role, said in read_back(text):
            self.said.update(f"{role}\n{said}\n".encode())
            self.turns += 1
        for a, b in zip(starts, ends, strict=True):
            own = unescaped(text[a:b])
            self.learned.update(own.encode())
            self.loss += len(own)
        self.size += len(text)

    def row(self, key: int | None) -> tuple:
        if not self.known:
            return (key, None, None, None, None, None)
        return (key, self.turns, self.said.hexdigest(), self.loss, self.learned.hexdigest(), self.size)


def digests(formatted_rows: DataFrame) -> DataFrame:
    """conv_id and what reading the formatted texts back gives: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A conversation with a run of unknown layout has nulls. Those of one run are digested where they
    are; the runs of a longer one pass in order through one task, which keeps the state of a digest
    and no text.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = {n: "Int64" for n in ("conv_id", "n_turns", "loss_chars", "formatted_chars")}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = _Digest()
        for frame in frames:
            rows = []
            for key, part, parts, text, starts, ends in zip(*(frame[c] for c in ("id", "run", "runs", "text", "loss_starts", "loss_ends")), strict=True):
                if part == 0:
                    state = _Digest()
                state.add(text, starts, ends)
                if part == parts - 1:
                    rows.append(state.row(None if pd.isna(key) else int(key)))
            yield pd.DataFrame(rows, columns=names).astype(kinds)

    shape = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    formatted_rows = written(formatted_rows)
    short, long = formatted_rows.where("runs = 1"), formatted_rows.where("runs > 1")
    return short.mapInPandas(run, shape).union(long.repartition("id").sortWithinPartitions("id", "run").mapInPandas(run, shape))
