"""License scans: MinHash bands over overlapping windows find templates, shingle containment proves them.

A window is as long as the template, or 16 words of a longer one, and starts at every word. Its MinHash has
one row in each of 8 bands: a window with Jaccard similarity J to a template's window shares a band with it
with probability 1 - (1 - J)^8, so 0.998 at 0.55 and 0.99998 at 0.75. What is found is placed against the
whole template, whose five-word shingles are then counted in the document exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywise.llm.common import mix, pieces, split_words, window_hashes

BANDS, WINDOW, SHINGLE = 8, 16, 5
#: Templates are sent to every task; more text than this is refused.
MOST_TEMPLATE_BYTES = 16 << 20
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")

# Public license notices, as their publishers word them.
TEMPLATES = {
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied."),
    "MIT-short": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software."),
    "GPL-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:"),
    "CC-BY-NC-4.0-short": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MIT-full": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        'copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY '
        "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
        "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "BSD-2-Clause-full": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE "
        'COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
        "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
        "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
        "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    "BSD-3-Clause-full": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright "
        "holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND "
        'CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
        "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
        "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
        "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
        "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
        "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    "ISC-full": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE "
        "FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS "
        "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING "
        "OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
}


def template_table(spark, templates: dict[str, str] | None = None) -> DataFrame:
    return spark.createDataFrame(list((templates or TEMPLATES).items()), "license_id string, text string")


class _Tokens:
    """Hashes of a batch's words without marks at their ends; words of marks alone are left out."""

    def __init__(self, text: pa.Array):
        words = split_words(text, lower=True)
        plain = [_EDGE.sub("", w) for w in words.vocab.to_pylist()]
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) if w else 0 for w in plain), np.uint64, len(plain))
        flat = hashes[words.codes] if len(words.codes) else np.empty(0, np.uint64)
        full = flat != 0
        self.flat = flat[full]
        self.starts = np.concatenate(([0], np.cumsum(full)))[words.starts]
        self.word = np.flatnonzero(full)  # the place of each among all words of the batch
        self.first_word = words.starts


def _minima(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` consecutive values, by doubling."""
    done, have = 1, values
    while done * 2 <= size:
        have = np.minimum(have[:-done], have[done:])
        done *= 2
    return have if done == size else np.minimum(have[:len(values) - size + 1], have[size - done:])


class Catalogue:
    """The templates' bands by window length, and their shingles."""

    def __init__(self, templates: list[tuple[str, str]]):
        tokens = _Tokens(pa.array([t for _, t in templates], pa.string()))
        self.ids, self.sizes, self.shingles = [], [], []
        bands: dict[int, list] = {}
        for i, (name, _) in enumerate(templates):
            flat = tokens.flat[tokens.starts[i]:tokens.starts[i + 1]]
            if len(flat) < SHINGLE:
                raise ValueError(f"template {name!r} has fewer than {SHINGLE} words")
            shingles = window_hashes(flat, SHINGLE)
            window = min(WINDOW, len(flat))
            n = len(self.ids)
            for b in range(BANDS):
                low = _minima(_row(shingles, b), window - SHINGLE + 1)
                bands.setdefault(window, []).extend((b, v, n, at) for at, v in enumerate(low))
            self.ids.append(name)
            self.sizes.append(len(flat))
            self.shingles.append(np.unique(shingles))
        self.bands = {}
        for window, rows in bands.items():
            for b in range(BANDS):
                own = [r[1:] for r in rows if r[0] == b]
                key = np.array([r[0] for r in own], np.uint64)
                order = np.argsort(key, kind="stable")
                self.bands[window, b] = (key[order], np.array([r[1] for r in own])[order],
                                         np.array([r[2] for r in own])[order])


def _row(shingles: np.ndarray, band: int) -> np.ndarray:
    return mix(shingles ^ np.uint64(0x9E3779B97F4A7C15 * (band + 1) % (1 << 64)))


def _candidates(tokens: _Tokens, catalogue: Catalogue) -> np.ndarray:
    """Distinct ``(document, template, start)``: where in the batch a template found by a band would start.

    Windows lie within one document each, so that its neighbours in the batch don't matter; a document shorter
    than a window is one.
    """
    shingles, sizes = window_hashes(tokens.flat, SHINGLE), np.diff(tokens.starts)
    found = [np.empty((0, 3), np.int64)]
    if not len(shingles):
        return found[0]
    doc_of = np.repeat(np.arange(len(sizes)), sizes)
    places = {}
    for window in {w for w, _ in catalogue.bands}:
        first = np.arange(max(0, len(tokens.flat) - window + 1))
        short = np.flatnonzero((sizes >= SHINGLE) & (sizes < window))
        places[window] = first[doc_of[first] == doc_of[first + window - 1]], short
    for b in range(BANDS):
        row = _row(shingles, b)
        for (window, band), (keys, template, offset) in catalogue.bands.items():
            if band != b:
                continue
            inside, short = places[window]
            low, start, doc = [], np.concatenate((inside, tokens.starts[short])), np.concatenate((doc_of[inside], short))
            if len(inside):
                low.append(_minima(row, window - SHINGLE + 1)[inside])
            if len(short):
                edges = np.stack((tokens.starts[short], tokens.starts[short + 1] - SHINGLE + 1), axis=1).ravel()
                low.append(np.minimum.reduceat(np.append(row, row[-1]), edges)[::2])
            low = np.concatenate(low) if low else np.empty(0, np.uint64)
            first, last = np.searchsorted(keys, low, "left"), np.searchsorted(keys, low, "right")
            at = np.flatnonzero(last > first)
            for k in range(int((last[at] - first[at]).max()) if len(at) else 0):
                some = at[first[at] + k < last[at]]
                i = first[some] + k
                found.append(np.stack((doc[some], template[i], start[some] - offset[i]), axis=1))
    return np.unique(np.concatenate(found), axis=0)


def _found_in(hits: np.ndarray, shingles: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """How many distinct shingles of the template ``low`` to ``high`` holds, and the span of those."""
    a, b = np.searchsorted(hits, (low, high - SHINGLE + 1))
    if a >= b:
        return 0, low, low
    return len(np.unique(shingles[hits[a:b]])), int(hits[a]), int(hits[b - 1]) + SHINGLE


def _matches(text: pa.Array, catalogue: Catalogue, containment: float) -> list[list[dict]]:
    """For each text its matches; of each template those with the most shingles that do not overlap.

    Each place is judged by itself, with a quarter of the template's length on either side. Where none of a run
    of places holds enough, the whole run is judged: passages that were inserted keep its parts apart. A run
    goes on while the next place is no farther than the template's length from the one before.
    """
    tokens = _Tokens(text)
    shingles = window_hashes(tokens.flat, SHINGLE)
    candidates = _candidates(tokens, catalogue)
    out: list[list[dict]] = [[] for _ in range(len(tokens.starts) - 1)]
    groups = np.flatnonzero((np.diff(candidates[:, :2], axis=0) != 0).any(axis=1)) + 1 if len(candidates) else []
    for part in np.split(candidates, groups) if len(candidates) else []:
        doc, t = part[0, :2].tolist()
        size, wanted = catalogue.sizes[t], catalogue.shingles[t]
        low, high = tokens.starts[doc], tokens.starts[doc + 1]
        hits = low + np.flatnonzero(np.isin(shingles[low:max(low, high - SHINGLE + 1)], wanted))
        slack, least = size // 4, containment * len(wanted)
        spans = [(max(s - slack, low), min(s + size + slack, high)) for s in part[:, 2].tolist()]
        spans = [(a, b) for a, b in spans if a < b]
        runs: list[list] = []
        for span in spans:
            if runs and span[0] <= runs[-1][-1][1] + size:
                runs[-1].append(span)
            else:
                runs.append([span])
        for run in runs:
            judged = sorted((-n, a, b) for n, a, b in {_found_in(hits, shingles, *s) for s in run} if n >= least)
            if not judged and len(run) > 1:
                n, a, b = _found_in(hits, shingles, run[0][0], max(s[1] for s in run))
                judged = [(-n, a, b)] * (n >= least)
            taken: list[tuple[int, int]] = []
            for n, a, b in judged:
                if all(b <= x or y <= a for x, y in taken):
                    taken.append((a, b))
                    word = tokens.word[[a, b - 1]] - tokens.first_word[doc]
                    out[doc].append({"license_id": catalogue.ids[t], "start": int(word[0]), "end": int(word[1]) + 1,
                                     "containment": -n / len(wanted)})
    return [sorted(m, key=lambda x: (x["start"], x["license_id"])) for m in out]


def scan(docs: DataFrame, templates: DataFrame, containment: float = 0.75, most_bytes: int = 12 << 20) -> DataFrame:
    """``doc_id, licenses`` for each row of ``docs(doc_id, text, ...)``.

    ``licenses`` are the matches ``(license_id, start, end, containment)`` in order of place: spans of words
    (runs of anything but ASCII white space) that hold at least ``containment`` of the distinct five-word
    shingles of a template of ``templates(license_id, text)``. Case and marks at the ends of words do not
    count. Matches of one template do not overlap, the fullest come first; those of different templates may.
    Passages inserted into a template, each of up to about its length, keep it one match. What a text holds does
    not depend on other rows. Templates have five words or more each and ``MOST_TEMPLATE_BYTES`` of text together
    (more is an error, found before they are read), as they are sent to every task; those with a null text are
    left out. A null or empty text has no matches. Rows that repeat, or share a doc_id, each give their row;
    doc_id may have any type; other columns are not used.
    """
    rows = templates.where("text is not null").select("license_id", "text")
    if (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > MOST_TEMPLATE_BYTES:
        raise ValueError("more template text than MOST_TEMPLATE_BYTES")
    catalogue = Catalogue([(r.license_id, r.text) for r in rows.orderBy("license_id", "text").collect()])
    kind = pa.list_(pa.struct([("license_id", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                               ("containment", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
            for part in pieces(64 + sizes.astype(np.int64), most_bytes):
                some = batch.slice(part.start, part.stop - part.start)
                found = _matches(some.column("text"), catalogue, containment)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(found, kind)],
                                                 ["doc_id", "licenses"])

    match = T.StructType().add("license_id", "string").add("start", "long").add("end", "long").add("containment", "double")
    schema = docs.select("doc_id").schema.add("licenses", T.ArrayType(match))
    return docs.select("doc_id", "text").mapInArrow(run, schema)
