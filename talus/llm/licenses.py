"""License scans by canonical digest.

A text is brought to a canonical form (case, copyright lines, equivalent spellings, punctuation, white space), digested as
a whole, and hash-joined with the digests of known licences. Everything runs in built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that count as equal, as in the matching guidelines for licence lists.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"), ("capitalisation", "capitalization"), ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"),
    ("copyright owner", "copyright holder"), ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"), ("maximise", "maximize"), ("modelled", "modeled"),
    ("modelling", "modeling"), ("noncommercial", "non commercial"), ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"), ("per cent", "percent"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"), ("sublicence", "sublicense"),
    ("sub license", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("http", "https"),
)
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ZERO_BSD = _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
_MIT_ZERO = _MIT.replace(", subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "")
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""


def _gnu(name: str, version: str, later: bool) -> str:
    """The customary notice of a GNU licence of this name and version."""
    terms = f"either version {version} of the License, or (at your option) any later version" if later else f"version {version} of the License"
    return f"""This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, {terms}.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.

You should have received a copy of the GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>."""


_GNU = {"GPL": "General Public License", "LGPL": "Lesser General Public License", "AGPL": "Affero General Public License"}
_CREATIVE = ("CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC-BY-NC-ND-4.0")
#: Whole texts, each known without a title and under each of its titles.
WHOLE = (
    ("MIT", _MIT, ("MIT License", "The MIT License", "The MIT License (MIT)")), ("MIT-0", _MIT_ZERO, ("MIT No Attribution",)), ("ISC", _ISC, ("ISC License", "The ISC License")),
    ("0BSD", _ZERO_BSD, ("BSD Zero Clause License", "Zero-Clause BSD")), ("Zlib", _ZLIB, ("zlib License", "The zlib License")), ("BSL-1.0", _BOOST, ("Boost Software License - Version 1.0 - August 17th, 2003",)),
    ("BSD-2-Clause", f"{_BSD_HEAD}\n\n{_BSD_TAIL}", ("BSD 2-Clause License", "The BSD 2-Clause License")), ("BSD-3-Clause", f"{_BSD_HEAD}\n{_BSD_THIRD}\n\n{_BSD_TAIL}", ("BSD 3-Clause License", "The BSD 3-Clause License")),
    ("Unlicense", _UNLICENSE, ("The Unlicense",)),
)
#: Customary notices, which stand for the licence in the head of a file or in a line of their own.
NOTICES = (
    ("Apache-2.0", _APACHE), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("MPL-2.0", _MPL), ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."), ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."), ("ISC", "Licensed under the ISC License."), ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    *((f"{short}-{v}.0-{'or-later' if later else 'only'}", _gnu(name, v, later)) for short, name in _GNU.items() for v in ("2", "3") for later in (False, True) if (short, v) in (("GPL", "2"), ("GPL", "3"), ("LGPL", "3"), ("AGPL", "3"))),
    *((x, f"{verb} under {name}.") for x in _CREATIVE for verb in ("Licensed", "This work is licensed") for name in (x.replace("CC-", "CC ", 1).replace("-4.0", " 4.0"),)),
    *((x, f"SPDX-License-Identifier: {x}") for x in sorted({n for n, _, _ in WHOLE} | {"Apache-2.0", "MPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-3.0-only", "AGPL-3.0-only", "CC0-1.0", *_CREATIVE})),
)
#: Digests of the canonical form of whole licences as their stewards publish them; texts of this length are
#: known by their digests alone. "-only" names the text itself, which does not say whether later versions are allowed.
DIGESTS = (
    ("Apache-2.0", "ddf43cd7a85299d69287a7733f7cb2411b29224841fa5ab96578b44e87028064"),
    ("Apache-2.0", "a1bf2c5babe6eb167b63d03df676e64aa96db265aac065b06be8ecc6b17121db"),  # appendix with its copyright line filled in
    ("Apache-2.0", "37eb2635c89a4b4799c1112082eb0435e60f1e98fc3501d716eccffd756c15c7"),  # without the appendix
    ("Artistic-1.0-Perl", "ab9e0a4960f3366c6e09c86510fe9dd469d242185a905b440792fcc4a45b46ef"),
    ("BSD-3-Clause", "c174f115026f799e8a770b4fb7c8f42bc8ca555dc4db723ce746c1be80888878"),  # of the Regents
    ("CC0-1.0", "3e6e368fd02abd67188d1bf25b196ac79f5782b2079e9579134c5e3f71f9ab74"),
    ("GFDL-1.2-only", "8aeaf5e8e3488d7c9d65e8416c911f7fe37b3bd88429feabc64ec6283117b8eb"),
    ("GFDL-1.2-only", "2acb0667facdf10c3ff6172f1a2e993ae122fe820a8b033da3e2c4158a2574dc"),  # without the addendum
    ("GFDL-1.3-only", "fb286966d28cff8aa94a7303127495846303801d66ef183d841d5971038d2aa0"),
    ("GFDL-1.3-only", "93e853bc37989d49f1fd00ae391db08a02ca7f78b3e31e3aec176839bcdd7879"),  # without the addendum
    ("GPL-1.0-only", "e648cec4dd2cabc1cd94f480d35d0f2383d6ce10b78bded4aa673f878ac2f7c2"),
    ("GPL-2.0-only", "4f31cce3bde237c32577480190c27e9fe0beda6c8d1b0e6eb19aca5ed5beb0c3"),
    ("GPL-2.0-only", "fe1b3b930063faaab3409d916bb4fcf187369c3a9ec04bb58e3ee7363ffc0cd9"),  # without the appendix
    ("GPL-3.0-only", "6ff3a9a8b11f055a64cb21003d19dbe88dd6a41f7487672c402dfe38b6fe2582"),
    ("GPL-3.0-only", "5d527914d4539f34149cd198edb1e5de52322047d37781b3bd66403f12dc40e1"),  # without the appendix
    ("LGPL-2.0-only", "2f0a8618627c179dd830ddb8fa74635ae037468a5880f3b46a73915ae1990c24"),
    ("LGPL-2.0-only", "d449b5d838ee652333de62d88304ddcf67663cda782f1c7257ee9c9dae33dfb4"),  # without the appendix
    ("LGPL-2.1-only", "56d21d93f6012cbd7f1195b72528da245ccf843598ff833a87101eb36863f95b"),
    ("LGPL-2.1-only", "a7bd7bcc6f59de5c915482fc3cacdd5a1b6b27c24354df724c2ef3672dce9475"),  # without the appendix
    ("LGPL-3.0-only", "f0cae4b317f4f263dca8e79625f8d9c7618c87e0ca6665c79b0f1c12ac856938"),
    ("MPL-1.1", "cd5de03902834de96800990f6dd3416470bf9f581eab90fe12aa8f43b6574a9c"),
    ("MPL-1.1", "79e2392ab67e13ba80beab4bd9c1306713fe27b82250482a1fe72578afc84ce4"),  # without the exhibit
    ("MPL-2.0", "7b3b2f4ee49d8b1000843c9a54a29fe8c581252dc661717fe67a37c3913f188e"),
    ("MPL-2.0", "b72aa116ecfb1add9aa289051bc39c372b5c5749e5f990ddb29c1502c18bb2a2"),  # without the exhibits
)
#: All known texts; more can be passed to known().
TEXTS = (*((n, f"{title}\n{t}" if title else t) for n, t, titles in WHOLE for title in ("", *titles)), *NOTICES)
#: A line that begins like a statement of copyright and has a year or a sign; a licence's own sentences have neither.
_COPYRIGHT = r"(?m)^[ \t#*/;-]*(copyright\b[^\n]*(\(c\)|©|[0-9]{4})|\(c\)|©)[^\n]*$"


def _canonical(text: Column) -> Column:
    """As canonical(), with line breaks kept as such."""
    x = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(x, _COPYRIGHT, "")


def canonical(text: Column) -> Column:
    """A-Z in lower case; copyright statements go; all but letters and digits becomes one space; equivalent spellings.

    Null is the empty text. A space stands before and after the words, and between any two. Words stand two spaces apart
    while spellings are replaced, so that neighbours share none.
    """
    return _spelled(F.regexp_replace(_canonical(text), r"[^\p{L}\p{N}]+", "  "))


def _spelled(x: Column) -> Column:
    x = F.concat(F.lit(" "), x, F.lit(" "))
    for a, b in SPELLINGS:
        x = F.replace(x, F.lit(f" {a} ".replace(" ", "  ")[1:-1]), F.lit(f" {b} ".replace(" ", "  ")[1:-1]))
    return F.regexp_replace(x, " {2,}", " ")


def known(spark: SparkSession, texts: tuple[tuple[str, str], ...] = TEXTS, digests: tuple[tuple[str, str], ...] = DIGESTS) -> DataFrame:
    """license and digest of the known texts, brought to canonical form by the same expression, and of those known by
    their digests; a digest once."""
    rows = spark.createDataFrame(list(texts), "license string, text string").select("license", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    rows = rows.union(spark.createDataFrame(list(digests), "license string, digest string"))
    return rows.groupBy("digest").agg(F.min("license").alias("license"))


def notices(text: Column, known_notices: tuple[tuple[str, str], ...] = NOTICES) -> Column:
    """The licences whose notice is a line of the text: sorted, each once, comma-joined.

    Only lines in which all notices' common word stem stands are brought to canonical form, digested and looked up.
    """
    lines = F.filter(F.split(_canonical(text), "\n"), lambda x: x.rlike(_STEM))
    digests = F.transform(lines, lambda x: F.sha2(_spelled(F.regexp_replace(x, r"[^\p{L}\p{N}]+", "  ")), 256))
    table = F.array(*(F.struct(F.lit(n).alias("n"), F.sha2(canonical(F.lit(t)), 256).alias("d")) for n, t in known_notices if "\n" not in t))
    return F.when(F.size(lines) > 0, F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter(table, lambda k: F.array_contains(digests, k["d"])), lambda k: k["n"]))), ",")).otherwise("")


#: In every notice of one line.
_STEM = "licen[cs]e"


def find(docs: DataFrame, licenses: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, canonical digest, license and notices of every row; license is null where the whole text is no known one.

    notices names the licences of which a line of the text is a known notice. A row for each row, repeated ones included. A
    null text counts as empty, which is no licence and has no notices; texts are read whole, whatever their length; an
    empty table gives an empty result. Other columns are ignored. The join is on the digest; the known licences are
    broadcast only if Spark finds them small enough.
    """
    licenses = known(docs.sparkSession) if licenses is None else licenses.groupBy("digest").agg(F.min("license").alias("license"))
    rows = docs.select(F.col(id_col), F.sha2(canonical(F.col(text_col)), 256).alias("digest"), notices(F.col(text_col)).alias("notices"))
    return rows.join(licenses, "digest", "left").select(id_col, "digest", "license", "notices")


def oracle_sql(table: str = "documents") -> str:
    """find() over a table in DuckDB's SQL."""

    def lines(x: str) -> str:
        return f"regexp_replace(translate(coalesce({x}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_COPYRIGHT}', '', 'g')"

    def form(x: str) -> str:
        x = f"' ' || regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]+', '  ', 'g') || ' '"
        for a, b in SPELLINGS:
            x = f"replace({x}, '{f' {a} '.replace(' ', '  ')[1:-1]}', '{f' {b} '.replace(' ', '  ')[1:-1]}')"
        return f"sha256(regexp_replace({x}, ' {{2,}}', ' ', 'g'))"

    quoted = [(n, t.replace("'", "''")) for n, t in TEXTS]
    values = ", ".join(f"('{n}', '{t}')" for n, t in quoted)
    digests = ", ".join(f"('{n}', '{d}')" for n, d in DIGESTS)
    single = ", ".join(f"('{n}', '{t}')" for n, t in quoted if "\n" not in t)
    return f"""
    WITH known AS (SELECT digest, min(license) AS license FROM (SELECT license, {form(lines('text'))} AS digest FROM (VALUES {values}) v(license, text)
                   UNION ALL SELECT license, digest FROM (VALUES {digests}) w(license, digest)) GROUP BY digest),
    single AS (SELECT DISTINCT license, {form(lines('text'))} AS digest FROM (VALUES {single}) v(license, text)),
    d AS (SELECT doc_id, {lines('text')} AS clean FROM {table}),
    n AS (SELECT doc_id, clean, string_agg(DISTINCT single.license, ',' ORDER BY single.license) AS notices
          FROM (SELECT doc_id, clean, unnest(string_split(clean, chr(10))) AS line FROM d) l JOIN single ON regexp_matches(line, '{_STEM}') AND {form('line')} = single.digest GROUP BY doc_id, clean)
    SELECT d.doc_id, {form('d.clean')} AS digest, known.license, coalesce(n.notices, '') AS notices
    FROM d LEFT JOIN known ON known.digest = {form('d.clean')} LEFT JOIN n ON d.doc_id = n.doc_id AND d.clean = n.clean"""
