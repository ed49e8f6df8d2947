from faultline.llm import license_scan as L

from .conftest import CLASHING, documents


def scan(spark, rows, extra=()):
    out = L.scan_licenses(documents(spark, rows, extra), L.sentence_table(spark)).collect()
    return sorted(map(tuple, out), key=str)


def test_sequences_take_the_special_rule_first(spark):
    gpl = "This work is licensed under the GNU General Public License, version 3. Either version 3 of the License, or (at your option) any later version."
    mit = "Intro line\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.\nReleased under the MIT license!"
    bsd = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    got = scan(spark, [(1, gpl), (2, mit), (3, bsd), (4, "Licensed under CC BY-NC-SA 4.0.")])
    assert got == [(1, 2, 0, "GPL-or-later", 0), (2, 3, 1, "MIT,CC-BY-NC", 0), (3, 1, 0, "", 1), (4, 1, 0, "CC-BY-NC-SA", 0)]


def test_sentences_in_between_break_a_rule_only_if_known(spark):
    text = "Licensed under the Apache License, Version 2.0.\nSome words.\nYou may not use this file except in compliance with the License."
    other = "Licensed under the Apache License, Version 2.0.\nAll rights reserved.\nYou may not use this file except in compliance with the License."
    got = scan(spark, [(1, text), (2, other)])
    assert got == [(1, 2, 0, "Apache", 0), (2, 3, 0, "Apache,All-rights-reserved", 1)]


def test_odd_rows(spark, odd_rows, empty):
    many = "All rights reserved.\n" * 3000
    got = scan(spark, [*odd_rows, (9, many), (9, many)], CLASHING)
    assert len(got) == len(odd_rows) + 2
    assert [r[1:] for r in got if r[0] == 9] == [(3000, 0, "All-rights-reserved", 0)] * 2
    assert all(r[1:] == (0, None, "", 0) for r in got if r[0] != 9)
    assert L.scan_licenses(empty, L.sentence_table(spark)).count() == 0


MIT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions."""
GNU = """This {what} is free software{mark} you can redistribute it and/or modify
it under the terms of the GNU {name}General Public License as published by
the Free Software Foundation{end} either version {n} of the License, or
(at your option) any later version.

This {what} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {name}General Public License for more details."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
NAMES = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def test_standard_texts_wrapped_and_in_comments(spark):
    texts = {
        "MIT": MIT, "Apache": APACHE, "MPL": MPL, "BSD-2-Clause": BSD, "BSD-3-Clause": BSD + NAMES,
        "GPL-or-later": GNU.format(what="program", mark=":", name="", end=",", n=3),
        "LGPL": GNU.format(what="library", mark=";", name="Lesser ", end=";", n="2.1"), "AGPL": GNU.format(what="program", mark=":", name="Affero ", end=",", n=3),
    }
    old_gpl = GNU.format(what="program", mark=";", name="", end=";", n=2)
    rows, want = [], {}
    for name, text in [*texts.items(), ("GPL-or-later", old_gpl)]:
        forms = [text, text.replace("\n", "\r\n")]
        forms += ["\n".join(f"{mark} {line}".rstrip() for line in text.split("\n")) for mark in (" *", "#", "//")]
        for form in forms:
            want[len(rows)] = name
            rows.append((len(rows), form))
    got = {r[0]: r for r in scan(spark, rows)}
    assert {i: r[3] for i, r in got.items()} == want
    assert all(r[4] == 0 for r in got.values())
    assert got[0][2] == 4  # the number of the piece in which the grant begins


def test_a_blank_line_ends_a_sentence(spark):
    assert scan(spark, [(1, "Released under the\n\nMIT License."), (2, "Released under the\nMIT License."), (3, "Not released under the\nMIT License.")]) == [
        (1, 0, None, "", 0), (2, 1, 0, "MIT", 0), (3, 0, None, "", 0)]
