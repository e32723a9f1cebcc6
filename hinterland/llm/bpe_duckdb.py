"""Byte-level BPE as relational queries that DuckDB runs inside each task."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hinterland.llm.segments import space_pieces
from hinterland.llm.worker import kept

#: Each step joins the token rows of every unfinished word to the merge table and contracts the
#: leftmost pair of the smallest rank; a word without a pair is done.
_SHORT = """
WITH RECURSIVE steps(word, pos, token, done) AS (
    SELECT word, pos, token, FALSE FROM bytes
    UNION ALL (
    WITH live AS MATERIALIZED (
        SELECT word, pos, token, lead(token) OVER w AS next_token, lead(word) OVER w AS next_word,
            lead(pos) OVER w AS next_pos
        FROM steps WHERE NOT done WINDOW w AS (ORDER BY pos)),
    best AS (
        SELECT word, min(rank::BIGINT << 32 | pos) AS low,
            arg_min(next_pos, rank::BIGINT << 32 | pos) AS taken
        FROM live JOIN merges ON pair = token::BIGINT << 32 | next_token
        WHERE next_word = word GROUP BY word)
    SELECT word, pos, CASE WHEN pos = (low & 4294967295) THEN (low >> 32)::INT ELSE token END,
        low IS NULL
    FROM live LEFT JOIN best USING (word)
    WHERE taken IS NULL OR pos <> taken))
SELECT word, token FROM steps WHERE done ORDER BY pos
"""
#: Words of more bytes are contracted many pairs at a time.
_LONG_BYTES = 64

#: The same for long words, with fewer steps: all pairs of the smallest rank from left to
#: right. ``risky`` ranks make a token that can at once be part of a pair of smaller rank; of
#: those only the leftmost is contracted, as one at a time is what the encoding means.
_LONG = """
WITH RECURSIVE steps(word, pos, token, step) AS (
    SELECT word, pos, token, 0 FROM bytes
    UNION ALL
    SELECT word, pos, new_token, step + 1 FROM (
        SELECT *, CASE WHEN taken THEN rank ELSE token END AS new_token,
            coalesce(lag(taken) OVER (PARTITION BY word ORDER BY pos), FALSE) AS gone
        FROM (
            SELECT *, rank = least AND (CASE WHEN risky THEN nth = 1
                ELSE (row_number() OVER (PARTITION BY word, rank = least, place - nth ORDER BY pos)) % 2 = 1
                END) IS TRUE AND rank IS NOT NULL AS taken
            FROM (
                SELECT *, row_number() OVER (PARTITION BY word, rank = least ORDER BY pos) AS nth
                FROM (
                    SELECT p.*, m.rank, m.risky, min(m.rank) OVER (PARTITION BY word) AS least
                    FROM (
                        SELECT *, lead(token) OVER w AS next_token, row_number() OVER w AS place
                        FROM steps WINDOW w AS (PARTITION BY word ORDER BY pos)
                    ) p LEFT JOIN merges m ON m.pair = p.token::BIGINT << 32 | p.next_token
                ) WHERE least IS NOT NULL)))
    WHERE NOT gone)
SELECT word, token FROM steps
QUALIFY step = max(step) OVER (PARTITION BY word)
ORDER BY word, pos
"""

_DECODE = "SELECT piece FROM tokens JOIN vocabulary USING (token) ORDER BY pos"


class RankEncoder:
    """Merge and vocabulary tables of one rank file in a DuckDB connection of this process."""

    def __init__(self, path: str, pattern: str) -> None:
        import duckdb
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._pattern = regex.compile(pattern)
        self._single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        a, b, rank, risky = [], [], [], set()
        for token, r in self.ranks.items():
            for cut in range(1, len(token)):
                x, y = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if x is not None and y is not None:
                    a.append(x), b.append(y), rank.append(r)
                    risky.update(q for q in (x, y) if q > r)
        self._db = duckdb.connect()
        self._db.execute("SET threads = 1; SET memory_limit = '400MB'; SET preserve_insertion_order = false")
        pair = np.array(a, np.int64) << 32 | np.array(b, np.int64)
        merges = pa.table({"pair": pair, "rank": pa.array(rank, pa.int32()),
                           "risky": pa.array([r in risky for r in rank])})
        vocabulary = pa.table({"token": pa.array(self.ranks.values(), pa.int32()),
                               "piece": pa.array(self.ranks.keys(), pa.binary())})
        for name, table in (("merges", merges), ("vocabulary", vocabulary)):
            self._db.register("given", table)
            self._db.execute(f"CREATE TABLE {name} AS FROM given")
            self._db.unregister("given")
        self._words: dict[str, bytes] = {}
        self._first: dict[str, bytes] = {}
        self._later: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        """Ids of words not met before, about a megabyte of token rows at a time."""
        held: tuple[list, list] = ([], [])
        size = [0, 0]
        for word in words:
            data = word.encode()
            k = len(data) > _LONG_BYTES
            held[k].append(data)
            size[k] += len(data)
            if size[k] > 1 << 20:
                self._contract(held[k], k)
                held[k].clear()
                size[k] = 0
        for k in (False, True):
            if held[k]:
                self._contract(held[k], k)

    def _contract(self, words: list[bytes], long: bool) -> None:
        length = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words), np.uint8)
        self._db.register("bytes", pa.table({
            "word": np.repeat(np.arange(len(words), dtype=np.int32), length),
            "pos": np.arange(len(data), dtype=np.int32), "token": self._single[data]}))
        found = self._db.execute(_LONG if long else _SHORT).fetchnumpy()
        self._db.unregister("bytes")
        token = np.asarray(found["token"]).astype("<u4")
        cut = np.searchsorted(np.asarray(found["word"]), np.arange(len(words) + 1))
        for i, word in enumerate(words):
            self._words[word.decode()] = token[cut[i]:cut[i + 1]].tobytes()

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        split = [self._pattern.findall(p) for p in pieces]
        self._learn(list({w for words in split for w in words} - self._words.keys()))
        get = self._words.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if len(self._words) + len(self._first) + len(self._later) > 900_000:
            self._words, self._first, self._later = {}, {}, {}
        cut = [space_pieces(t) for t in texts]
        first = list({p[0] for p in cut if p} - self._first.keys())
        later: set[str] = set()
        for p in cut:
            if p:
                later.update(p[1:])
        later = list(later - self._later.keys())
        odd = [t for t, p in zip(texts, cut) if p is None]
        found = self._pieces(first + [" " + p for p in later] + odd)
        self._first.update(zip(first, found))
        self._later.update(zip(later, found[len(first):]))
        whole = iter(found[len(first) + len(later):])
        get = self._later.__getitem__
        return [next(whole) if p is None else self._first[p[0]] + b"".join(map(get, p[1:])) for p in cut]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Bytes of each list of ids: token rows meet the vocabulary and are put in order again."""
        count = np.array([len(x) // 4 for x in ids])
        tokens = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
        if not len(tokens):
            return [b""] * len(ids)
        self._db.register("tokens", pa.table({
            "pos": np.arange(len(tokens), dtype=np.int32), "token": tokens}))
        pieces = self._db.sql(_DECODE).to_arrow_table().column("piece").cast(pa.large_binary())
        self._db.unregister("tokens")
        pieces = pieces.combine_chunks()
        _, ends, data = pieces.buffers()
        ends = np.frombuffer(ends, np.int64)[pieces.offset:]
        data = memoryview(data)
        last = np.concatenate([[0], np.cumsum(count)])
        return [bytes(data[a:b]) for a, b in zip(ends[last[:-1]], ends[last[1:]])]


def encode_decode(
    docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
    with_outputs: bool = True,
) -> DataFrame:
    """One row a document: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked for,
    ``ids`` and ``decoded``.

    Words are the matches of ``pattern``, each encoded by ranks alone; the ids are then decoded
    to bytes. A task runs both as DuckDB queries over its own rows, in blocks of about a
    megabyte of text, and contracts each distinct word once. Nothing is shuffled.

    NULL texts are empty and have no ids. Repeated rows get a row each, ids may be NULL, other
    columns are ignored. A text is never cut, so one word may be as long as the text.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
              ("decoded_sha256", pa.string())]
    if with_outputs:
        fields += [("ids", pa.list_(pa.int32())), ("decoded", pa.binary())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What a worker has met serves its later tasks.
        encoder = kept(("ranks", ranks, pattern), lambda: RankEncoder(ranks, pattern))
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            start, size = 0, 0
            for i in range(batch.num_rows):
                size += len(texts[i].as_py() or "")
                if size > 1 << 20 or i + 1 == batch.num_rows:
                    part = [t or "" for t in texts.slice(start, i + 1 - start).to_pylist()]
                    ids = encoder.encode(part)
                    decoded = encoder.decode(ids)
                    columns = [names[start:i + 1], [len(x) // 4 for x in ids],
                               [hashlib.sha256(x).hexdigest() for x in ids],
                               [hashlib.sha256(x).hexdigest() for x in decoded]]
                    if with_outputs:
                        columns += [[np.frombuffer(x, "<i4") for x in ids], decoded]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
                    start, size = i + 1, 0

    extra = ", ids array<int>, decoded binary" if with_outputs else ""
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + extra)
