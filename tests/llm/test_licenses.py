"""License notices: planted ones are found where they are, close variants told apart."""

import random

import pytest

from skyloom.llm import licenses


@pytest.mark.parametrize("name, text", licenses.TEMPLATES)
def test_each_template_is_found_anywhere(name, text):
    matcher = licenses.Matcher(licenses.TEMPLATES)
    random.seed(len(text))
    for before in (0, 1, 7, 50, 333):
        filler = " ".join(random.choices(["alpha", "beta", "gamma", "delté"], k=before))
        whole = f"{filler} {text} {filler}".strip()
        values, _ = licenses._shingle_list([licenses._folded(whole)])
        found = matcher.matches(whole, values)
        assert [m[0] for m in found] == [name]
        assert whole[found[0][2]:found[0][3]].rstrip(".") in text and found[0][1] == 1.0


def test_rows(odd_docs, docs_of):
    rows = [(1, "x Released under the MIT License. y\nThis work is licensed under the GNU General Public License, version 2."),
            (2, "Licensed under a fee. Released today. The MIT building."), (3, "released under  the\nMIT license")]
    got = sorted(tuple(r)[:2] for r in licenses.find_licenses(docs_of(rows)).collect())
    assert got == [(1, "GPL-2.0"), (1, "MIT"), (3, "MIT")]
    assert licenses.find_licenses(odd_docs).collect() == [] and licenses.find_licenses(docs_of([])).collect() == []


def test_a_changed_long_notice_still_counts(docs_of):
    text = next(t for n, t in licenses.TEMPLATES if len(t) > 150 and n == "Apache-2.0").replace("express", "explicit")
    row = licenses.find_licenses(docs_of([(1, "word " * 40 + text)])).first()
    assert row["license"] == "Apache-2.0" and 0.8 <= row["containment"] < 1


@pytest.mark.parametrize("names", [("CC-BY-4.0", "CC-BY-SA-4.0"), ("CC-BY-SA-4.0", "CC-BY-4.0"), ("GPL-2.0", "GPL-3.0"), ("GPL-3.0", "GPL-2.0"),
                                   ("MIT",) * 3, ("GPL-2.0", "GPL-2.0", "GPL-3.0"), ("CC-BY-NC-4.0",) * 2])
@pytest.mark.parametrize("between", ["", "and one more word"])
def test_similar_notices_side_by_side(names, between):
    matcher = licenses.Matcher(licenses.TEMPLATES)
    text_of = {name: text for name, text in reversed(licenses.TEMPLATES)}
    whole, places = "", []
    for name in names:
        places.append((name, 1.0, len(whole), len(whole) + len(text_of[name].rstrip("."))))
        whole += f"{text_of[name]} {between} "
    values, _ = licenses._shingle_list([licenses._folded(whole)])
    assert sorted(matcher.matches(whole, values), key=lambda m: m[2]) == places


def test_changed_copies_side_by_side():
    words = next(t for n, t in licenses.TEMPLATES if len(t) > 150 and n == "MIT").split()
    one, two = [*words], [*words]
    one[8] = two[20] = "changed"
    whole = " ".join(one + two)
    values, _ = licenses._shingle_list([licenses._folded(whole)])
    first, second = licenses.Matcher(licenses.TEMPLATES).matches(whole, values)
    assert first[3] <= len(" ".join(one)) < second[2] + 1 and first[1] == second[1] >= 0.8


HEADER = """/* This {what} is free software{sign} you can redistribute it and/or
 * modify it under the terms of the GNU {kind}General Public License
 * as published by the Free Software Foundation; either version {version}
 * of the License, or (at your option) any later version.
 *
 * This {what} is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
 * {kind}General Public License for more details. */"""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
   disclaimer in the documentation and/or other materials provided with the distribution.
{third}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT"""
THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
   derived from this software without specific prior written permission."""


@pytest.mark.parametrize("name, text", [
    *[(name, HEADER.format(kind=kind, version=version, what=what, sign=sign)) for name, kind, version in (
        ("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3"), ("AGPL-3.0", "Affero ", "3"))
      for what in ("program", "library", "file is part of Skyloom. Skyloom") for sign in (";", ":")],
    ("BSD-2-Clause", BSD.format(third="")), ("BSD-3-Clause", BSD.format(third=THIRD))])
def test_standard_headers(name, text):
    whole = f"int main;\n{text}\n#include more words here"
    values, _ = licenses._shingle_list([licenses._folded(whole)])
    assert [m[0] for m in licenses.Matcher(licenses.TEMPLATES).matches(whole, values)] == [name]
