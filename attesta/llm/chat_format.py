"""Chat conversations as token ids with a loss mask.

A turn is spliced from reserved ids and separately encoded segments, so no text
can make a reserved id: TURN role TEXT text END, and BEGIN before the first turn.
The mask has a prefix sum for its form: +1 where an assistant's text begins, -1
after its END. Control strings inside roles and texts are broken by an escape
mark, which can be undone, so that the rendered string can be split again too.

Defined results: a null role or text is empty; turns are ordered by turn (null
first), then role and text, and repeated rows are turns of their own; rows of a
null conv_id are one conversation; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"\s*\S{1,40}|\s+"

BEGIN, TURN, TEXT, END = "<|begin|>", "<|turn|>", "<|text|>", "<|end|>"
# Control strings of common chat templates.
CONTROLS = (BEGIN, TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>", "<pad>", "<unk>")
ESC = "␛"
_BREAK = re.compile("|".join(map(re.escape, (ESC, *sorted(CONTROLS, key=len, reverse=True)))))
_UNDO = re.compile(f"{ESC}([{ESC}.])")


def escape(text: str) -> str:
    """No control string stands in the result; ``unescape`` gives the text back."""
    return _BREAK.sub(lambda m: ESC + ESC if m[0] == ESC else f"{m[0][0]}{ESC}.{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _UNDO.sub(lambda m: ESC if m[1] == ESC else "", text)


@cache
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("attesta", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1


FORMATTED = "conv_id long, ids array<int>, mask array<tinyint>, rendered string"


def _assemble(turns: list[tuple[str, str]], path: str) -> tuple[np.ndarray, np.ndarray, str]:
    """Ids, mask and rendered string of one conversation."""
    enc, top = encoder(path)
    segments, marks, pieces = [[top]], [0], [BEGIN]
    for role, text in turns:
        role_, text_ = escape(role), escape(text)
        on = int(role == "assistant")
        segments += [[top + 1], enc.encode_ordinary(role_), [top + 2], enc.encode_ordinary(text_), [top + 3]]
        marks += [0, 0, 0, on, on]
        pieces += [TURN, role_, TEXT, text_, END]
    length = np.array([len(s) for s in segments])
    ends = np.cumsum(length)
    step = np.zeros(int(ends[-1]) + 1, np.int64)
    np.add.at(step, ends - length, marks)
    np.add.at(step, ends, -np.array(marks))
    return np.concatenate([np.asarray(s, np.int32) for s in segments]), np.cumsum(step)[:-1].astype(np.int8), "".join(pieces)


def format_conversations(turns: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Rows of (conv_id, turn, role, text) -> conv_id, ids, mask, rendered. ``tokenizer``: a rank file on every machine."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    schema = pa.schema([("conv_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("mask", pa.list_(pa.int8())), ("rendered", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        held, own = None, []
        size = 0

        def close() -> None:
            done.append((held[0], *_assemble(own, tokenizer)))

        for b in batches:
            for c, role, text in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True):
                if held is not None and held[0] != c:
                    close()
                    size, own = size + len(done[-1][1]), []
                    if size > 200_000:
                        yield _rows(done, schema)
                        size, done = 0, []
                held = (c,)
                own.append((role, text))
        if held is not None:
            close()
        if done:
            yield _rows(done, schema)

    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, FORMATTED)


def _rows(done: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"


def read_back(formatted: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """What the ids, the mask and the rendered string say: turns, their digest, the text under the mask.

    Ids and rendered string must tell the same turns; a row in which they differ is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, top = encoder(tokenizer)
        split = re.compile(f"{re.escape(TURN)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}", re.S)
        for b in batches:
            out = []
            for c, ids, mask, text in zip(*(b.column(k) for k in ("conv_id", "ids", "mask", "rendered")), strict=True):
                ids, mask = ids.values.to_numpy(), mask.values.to_numpy(zero_copy_only=False)
                at = np.flatnonzero(ids >= top)
                part = [unescape(enc.decode(ids[x + 1 : y].tolist())) for x, y in zip(at, np.r_[at[1:], len(ids)], strict=True)]
                turns = [(part[k], part[k + 1]) for k in np.flatnonzero(ids[at] == top + 1)]
                text = text.as_py()
                if turns != [(unescape(r), unescape(t)) for r, t in split.findall(text)]:
                    raise ValueError(f"conversation {c}: ids and rendered string differ")
                # runs of masked ids; each holds one escaped text
                under = ids.astype(np.int64)
                edge = np.flatnonzero(np.diff(np.r_[0, mask, 0]))
                loss = "".join(unescape(enc.decode([i for i in under[x:y] if i < top])) if (under[x:y] >= top).sum() <= 1 else "".join(_masked(under[x:y], top, enc)) for x, y in zip(edge[::2], edge[1::2], strict=True))
                said = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                out.append((c.as_py(), len(turns), said, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text), len(ids)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) if k not in (0,) else pa.array(x, pa.int64()) for k, x in enumerate(zip(*out, strict=True))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"])

    return formatted.mapInArrow(run, READ)


def _masked(ids: np.ndarray, top: int, enc) -> Iterator[str]:
    """Texts of one run of masked ids that reserved ids part."""
    cut = np.flatnonzero(ids >= top)
    for x, y in zip(np.r_[0, cut + 1], np.r_[cut, len(ids)], strict=True):
        yield unescape(enc.decode(ids[x:y].tolist()))
