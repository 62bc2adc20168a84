"""License notices: MinHash bands over overlapping windows retrieve templates, exact shingles verify them.

A text is read in windows of a few lengths, each overlapping the next by half, so any notice lies wholly within one window
of less than four times its length. A window and a template that share a band of their MinHash signatures are compared by
exact containment of the template's word shingles. Bands are one row wide and there are ``BANDS`` of them: a
window that holds 80 % of a template and is up to four times as long (similarity 0.19) still shares a band with
probability 1 - (1 - 0.19) ** 64, i.e. 0.999998. Windows without any shingle of a template cannot share a
band with one, so their signatures are not made.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from skyloom.llm.common import id_and_text, portions, texts_of
from skyloom.llm.shingles import _shingle_some, mix
from skyloom.llm.toxicity import _FOLD

WORDS, BANDS, CONTAINED = 3, 64, 0.8

# Short notices by SPDX name.
TEMPLATES = [
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                   "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                     "that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
# Standard headers and distinguishing passages.
TEMPLATES += [
    ("AGPL-3.0", "is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
                "General Public License as published by the Free Software Foundation, either version 3 of the "
                "License, or (at your option) any later version."),
    ("AGPL-3.0", "is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
                "General Public License as published by the Free Software Foundation, version 3 of the "
                "License."),
    ("AGPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
                "License version 3 as published by the Free Software Foundation"),
    ("GPL-2.0", "is free software: you can redistribute it and/or modify it under the terms of the GNU "
               "General Public License as published by the Free Software Foundation, either version 2 of the "
               "License, or (at your option) any later version."),
    ("GPL-2.0", "is free software: you can redistribute it and/or modify it under the terms of the GNU "
               "General Public License as published by the Free Software Foundation, version 2 of the "
               "License."),
    ("GPL-2.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License "
               "version 2 as published by the Free Software Foundation"),
    ("GPL-3.0", "is free software: you can redistribute it and/or modify it under the terms of the GNU "
               "General Public License as published by the Free Software Foundation, either version 3 of the "
               "License, or (at your option) any later version."),
    ("GPL-3.0", "is free software: you can redistribute it and/or modify it under the terms of the GNU "
               "General Public License as published by the Free Software Foundation, version 3 of the "
               "License."),
    ("GPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License "
               "version 3 as published by the Free Software Foundation"),
    ("LGPL-2.1", "is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
                "General Public License as published by the Free Software Foundation, either version 2.1 of "
                "the License, or (at your option) any later version."),
    ("LGPL-2.1", "is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
                "General Public License as published by the Free Software Foundation, version 2.1 of the "
                "License."),
    ("LGPL-2.1", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
                "License version 2.1 as published by the Free Software Foundation"),
    ("LGPL-3.0", "is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
                "General Public License as published by the Free Software Foundation, either version 3 of the "
                "License, or (at your option) any later version."),
    ("LGPL-3.0", "is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
                "General Public License as published by the Free Software Foundation, version 3 of the "
                "License."),
    ("LGPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
                "License version 3 as published by the Free Software Foundation"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                  "except in compliance with the License. You may obtain a copy of the License at "
                  "http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are "
                    "permitted provided that the following conditions are met: 1. Redistributions of source code "
                    "must retain the above copyright notice, this list of conditions and the following "
                    "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
                    "this list of conditions and the following disclaimer in the documentation and/or other "
                    "materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS "
                    "AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED "
                    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
                    "DISCLAIMED."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are "
                    "permitted provided that the following conditions are met: 1. Redistributions of source code "
                    "must retain the above copyright notice, this list of conditions and the following "
                    "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
                    "this list of conditions and the following disclaimer in the documentation and/or other "
                    "materials provided with the distribution. 3. Neither the name of the copyright holder nor "
                    "the names of its contributors may be used to endorse or promote products derived from this "
                    "software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE "
                    "COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, "
                    "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
                    "PURPOSE ARE DISCLAIMED."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
           "without fee is hereby granted, provided that the above copyright notice and this permission "
           "notice appear in all copies."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
           "software and associated documentation files (the \"Software\"), to deal in the Software "
           "without restriction, including without limitation the rights to use, copy, modify, merge, "
           "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
           "to whom the Software is furnished to do so, subject to the following conditions: The above "
           "copyright notice and this permission notice shall be included in all copies or substantial "
           "portions of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a "
               "copy of the MPL was not distributed with this file, You can obtain one at "
               "http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to "
                 "copy, modify, publish, use, compile, sell, or distribute this software, either in source "
                 "code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
                 "means."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and "
               "neighboring rights to this software to the public domain worldwide. This software is "
               "distributed without any warranty."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
]
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def _folded(text: str) -> bytes:
    """Letters and digits, A-Z lower-cased, everything else of ASCII a blank."""
    return text.encode().translate(_FOLD)


def _shingle_list(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    parts = list(_shingle_some(data, WORDS))
    return parts[0] if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


class Matcher:
    """The templates' shingles, signatures and bands."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.names = [name for name, _ in templates]
        self.words = [WORD.findall(_folded(text)) for _, text in templates]
        self.exact = [self._exact(w) for w in self.words]
        self.salts = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.bands: dict[tuple[int, int], list[int]] = {}
        hashes = []
        for i, (_, text) in enumerate(templates):
            values, _ = _shingle_list([_folded(text)])
            hashes.append(values)
            for band, value in enumerate(self.signature(values)):
                self.bands.setdefault((band, int(value)), []).append(i)
        self.shingles = np.unique(np.concatenate(hashes))
        lengths = [max(len(w), WORDS) for w in self.words]
        self.lengths = sorted({max(8, 1 << int(np.ceil(np.log2(2 * n)))) for n in lengths})

    @staticmethod
    def _exact(words: list[bytes]) -> set[tuple]:
        return {tuple(words[i:i + WORDS]) for i in range(max(1, len(words) - WORDS + 1))}

    def signature(self, values: np.ndarray) -> np.ndarray:
        return mix(values[:, None] ^ self.salts[None, :]).min(axis=0)

    def matches(self, text: str, values: np.ndarray) -> list[tuple[str, float, int, int]]:
        """(license, containment, start, end) of a text whose shingles are ``values`` in order; places are in code points."""
        at = np.flatnonzero(np.isin(values, self.shingles))
        if not len(at):
            return []
        found = set()
        spots = list(WORD.finditer(text.encode()))
        words = WORD.findall(_folded(text))
        for length in self.lengths:
            step, wide = length // 2, length - WORDS + 1
            windows = np.unique(np.concatenate([at // step, np.maximum(at - wide + 1, 0) // step, at // step - 1]))
            for start in (windows[windows >= 0] * step).tolist():
                part = values[start:start + wide]
                if not len(part):
                    continue
                near = {i for band, value in enumerate(self.signature(part)) for i in self.bands.get((band, int(value)), ())}
                here = self._exact(words[start:start + length])
                for i in near:
                    share = len(here & self.exact[i]) / len(self.exact[i])
                    if share >= CONTAINED:
                        found |= self._spans(words, start, min(start + length, len(words)), i)
        kept = self._best(found)
        data = text.encode()
        place = lambda byte: len(data[:byte].decode())
        return sorted((self.names[i], share, place(spots[a].start()), place(spots[b - 1].end())) for a, b, i, share in kept)

    def _spans(self, words: list[bytes], start: int, end: int, i: int) -> set[tuple[int, int, int, float]]:
        """(first, last word excluded, template, containment) of each shortest span of a window that holds so and so many
        of the template's shingles, for all numbers of them from ``CONTAINED`` on."""
        hits = [(k, tuple(words[k:k + WORDS])) for k in range(start, max(start + 1, end - WORDS + 1))]
        hits = [(k, shingle) for k, shingle in hits if shingle in self.exact[i]]
        size, found = len(self.exact[i]), set()
        for least in range(1, size + 1):
            if least / size < CONTAINED:
                continue
            held: dict[tuple, int] = {}
            left = 0
            for k, shingle in hits:
                held[shingle] = held.get(shingle, 0) + 1
                while held[hits[left][1]] > 1 or len(held) > least:
                    first = hits[left][1]
                    held[first] -= 1
                    if not held[first]:
                        del held[first]
                    left += 1
                if len(held) == least:
                    found.add((hits[left][0], min(k + WORDS, len(words)), i, least / size))
        return found

    def _best(self, found: set[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
        """The spans without overlaps that together weigh most.

        A span weighs the template's shingles it holds, less the more of the template it lacks and the more words it has
        beyond the template's own. So a notice outweighs its variants, and two notices a span over parts of both.
        """
        spans = sorted(found, key=lambda f: (f[1], f[0], f[2], f[3]))
        ends = [f[1] for f in spans]
        total, taken = [0.0], [False]
        for n, (first, last, i, share) in enumerate(spans):
            size = len(self.exact[i])
            weight = (share * size) ** 2 / (size + max(0, last - first - len(self.words[i])))
            weight += total[bisect_right(ends, first, 0, n)]
            taken.append(weight > total[n])
            total.append(max(weight, total[n]))
        kept, n = [], len(spans)
        while n:
            if taken[n]:
                kept.append(spans[n - 1])
                n = bisect_right(ends, spans[n - 1][0], 0, n - 1)
            else:
                n -= 1
        return kept


def find_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``doc_id, license, containment, start, end``: each notice found in each whole text, in code points.

    Null and empty texts and texts without a notice give no row; repeated rows give the same rows again; null ids stay; an
    empty table gives no rows; extra columns are ignored. Overlaps are resolved
    between the shortest spans that hold a notice, so notices side by side are each reported.
    """
    source = id_and_text(docs, id_col, text_col)
    schema = T.StructType([T.StructField("doc_id", source.schema["id"].dataType)]).add("license", "string").add(
        "containment", "double").add("start", "long").add("end", "long")
    chosen = TEMPLATES if templates is None else templates

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(chosen)
        for batch in portions(batches):
            texts = texts_of(batch)
            rows, found = [], []
            for start in range(0, len(texts), 200):
                some = texts[start:start + 200]
                values, of = _shingle_list([_folded(t) for t in some])
                for i in np.unique(of[np.isin(values, matcher.shingles)]).tolist():
                    for match in matcher.matches(some[i], values[of == i]):
                        rows.append(start + i)
                        found.append(match)
            columns = list(zip(*found)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(columns[0], pa.string()),
                 pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())],
                names=schema.names)

    return source.mapInArrow(run, schema)
