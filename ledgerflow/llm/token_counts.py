"""Token counts with overlap resynchronisation (operator 8).

A text up to ``chunk_chars`` is encoded as it is (by ``encoding``, which gives the library's ids). A longer one is encoded in chunks
that overlap; each chunk yields tokens with character offsets. Two neighbours are
spliced at a boundary inside their overlap that

* both encodings have as a token boundary,
* lies between a character that is not white space and a white-space character.
  The byte-level pattern starts a pre-token at every such place whatever stands
  before it, and no special string holds white space, so the boundary is one of
  the whole text too; after it both encodings see the same text,
* is followed in both encodings by the same tokens up to the next such boundary.

The left chunk counts up to the splice and the right chunk from it. Where the overlap
holds no such boundary it is widened (doubled) and encoded again, up to the end of
the text: a text without white space ends as one chunk, which is exact.

Defined cases: a null or empty text has 0 bytes and 0 tokens; a null id stays a row;
repeated rows each get a result; an empty table gives an empty result; other columns are
not read. Special strings inside a text count as the library's default does.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerflow.llm.common import documents, prepare
from ledgerflow.llm.encoding import encoder

COLUMNS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chunks long"

def tokenizer(path: str):
    """The library's tokenizer of ``path``, one per Python worker; it alone gives offsets."""
    return encoder(path).tokenizer


def _encode(tok, text: str) -> tuple[list[int], list[int]]:
    """Ids and the character offset at which each token starts."""
    enc = tok.encode(text, add_special_tokens=False)
    return enc.ids, [a for a, _ in enc.offsets]


def _stable(text: str, at: int) -> bool:
    """Between a character that is not white space and one that is."""
    return 0 < at < len(text) and not text[at - 1].isspace() and text[at].isspace()


def count_chunked(tok, text: str, chunk: int, overlap: int) -> tuple[int, int]:
    """Tokens of ``text`` and the number of chunks encoded, by overlapping chunks."""
    total, chunks = 0, 0
    begin = 0             # where the tokens not yet counted start: a boundary of the whole text
    end = min(len(text), begin + chunk)
    ids, starts = _encode(tok, text[begin:end])
    chunks += 1
    while end < len(text):
        width = overlap
        while True:
            right = max(begin, end - width)
            stop = min(len(text), right + max(chunk, 2 * width))
            r_ids, r_starts = _encode(tok, text[right:stop])
            chunks += 1
            at = _splice(text, (begin, ids, starts), (right, r_ids, r_starts), end)
            if at is not None or stop == len(text) and right == begin:
                break
            width *= 2
            if right == begin:  # the overlap already is the whole left chunk: go on with the longer right one
                ids, starts, end = r_ids, r_starts, stop
                if end == len(text):
                    break
        if at is None:
            # the chunk from ``begin`` reaches the end of the text
            ids, starts, end = r_ids, r_starts, stop
            break
        total += sum(1 for s in starts if begin + s < at)
        keep_from = next(i for i, s in enumerate(r_starts) if right + s >= at)
        begin, ids, starts, end = at, r_ids[keep_from:], [right + s - at for s in r_starts[keep_from:]], stop
    return total + len(ids), chunks


def _splice(text: str, left: tuple, right: tuple, left_end: int) -> int | None:
    """The first stable boundary that both encodings share, followed by the same tokens up to the next one."""
    (l0, l_ids, l_starts), (r0, r_ids, r_starts) = left, right
    r_at = {r0 + s: i for i, s in reversed(list(enumerate(r_starts))) if r0 + s < left_end}
    found = None
    for i, s in enumerate(l_starts):
        p = l0 + s
        if p <= r0 or p not in r_at or not _stable(text, p):
            continue
        if found is not None:
            (fi, fj, fp), j = found, r_at[p]
            if l_ids[fi:i] == r_ids[fj:j]:
                return fp
        found = (i, r_at[p], p)
    return None


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024, chunk_chars: int = 1 << 16,
                 overlap_chars: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every document (``COLUMNS``). A narrow step; a worker holds one batch and one chunk's tokens."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tok = encoder(tokenizer_path), tokenizer(tokenizer_path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            counts = [0] * len(texts)
            chunks = [1] * len(texts)
            short = [i for i, t in enumerate(texts) if len(t) <= chunk_chars]
            for k in range(0, len(short), 256):
                part = short[k:k + 256]
                for i, ids in zip(part, own.encode([texts[i] for i in part])):
                    counts[i] = len(ids) // 4
            for i, t in enumerate(texts):
                if len(t) > chunk_chars:
                    counts[i], chunks[i] = count_chunked(tok, t, chunk_chars, overlap_chars)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()),
                pa.array([c > limit for c in counts], pa.bool_()), pa.array(chunks, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_chunks"])

    return documents(docs, id_col, text_col).mapInArrow(run, COLUMNS)
