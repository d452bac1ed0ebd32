"""Substring deduplication on words: every run of 35 words that also stands elsewhere is removed.

Consecutive windows that share a minimiser travel as one packed string to the minimiser's bucket;
there a sort of window hashes brings candidates together and their words are counted exactly.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.superstrings import SMALL, Units, window_hashes, without_repeats

WINDOW, MINIMISER = 35, 4


def counted_windows(units: Units):
    """Whether each window of the strings is there more than once: sorted by hash, counted by content."""

    def repeats(strings: list[bytes]) -> np.ndarray:
        one, _ = window_hashes(strings, units)
        order = np.argsort(one, kind="stable")
        eq = one[order][1:] == one[order][:-1]
        near = np.zeros(len(one), bool)
        near[order[1:][eq]] = near[order[:-1][eq]] = True
        # first byte and end of every window
        text, bounds = units.joined(strings)
        starts, ends, _ = units.places(text)
        piece = np.searchsorted(bounds, starts, side="right")
        n = len(starts) - units.k + 1
        at = np.flatnonzero(piece[:n] == piece[units.k - 1 : units.k - 1 + n])
        look = np.flatnonzero(near)
        words = [text[a:z] for a, z in zip(starts[at[look]].tolist(), ends[at[look] + units.k - 1].tolist())]
        count = Counter(words)
        out = np.zeros(len(one), bool)
        out[look] = [count[w] > 1 for w in words]
        return out

    return repeats


def drop_repeated_windows(
    docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER, id_col: str = "doc_id", text_col: str = "text",
    small: int = SMALL,
) -> DataFrame:
    """(doc_id, kept, n_units, n_removed, n_spans, spans): texts without the words covered by a
    window of ``window`` words whose words also stand anywhere else, the same text included.

    Words are runs of characters other than the six ASCII white-space ones, unchanged; ``kept`` is
    the UTF-8 of the remaining ones joined by a space; spans count words. A null or empty text has no
    words. Every row is a text of its own: a repeated row makes both repeats, a null id is as good
    as another. Texts under ``window`` words stay whole; an empty table gives no rows; other columns
    are not read. A text is cut in pieces for the work, so its length has no bound but a row's.
    """
    units = Units(window, minimiser, True)
    return without_repeats(docs, units, counted_windows(units), id_col, text_col, small)


def digests(docs: DataFrame) -> DataFrame:
    done = drop_repeated_windows(docs)
    return done.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
pos AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS k FROM pos),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS p FROM dup, (SELECT unnest(range(0, 35)) AS o)),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
kept AS (
  SELECT doc_id, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY words.p) FILTER (WHERE gone.p IS NULL) AS t
  FROM words LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""
