"""Licence scans by canonical digest.

A text and each of its lines are brought to a canonical form (case, copyright lines, punctuation and equivalent
spellings are levelled), hashed, and hash-joined to the digests of known licences and notices.  Only entire
units match: a text that merely contains a licence is found by the lines that are notices of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.license_texts import TEXTS

#: Spellings that count as equal, as in the public matching guidelines for licence texts.
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "authorise": "authorize",
    "behaviour": "behavior",
    "catalogue": "catalog",
    "centre": "center",
    "copyright holder": "copyright owner",
    "favour": "favor",
    "fulfil ": "fulfill ",
    "https": "http",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "licence": "license",
    "maximise": "maximize",
    "minimise": "minimize",
    "non commercial": "noncommercial",
    "organisation": "organization",
    "owner s": "owners",
    "per cent": "percent",
    "recognise": "recognize",
    "sub license": "sublicense",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
}

#: Short licences and notices that are known from the start, by SPDX identifier.
SHORT = [
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This work is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "Licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("Unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest
in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of
our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and
future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""),
]

#: Title lines under which short licences are distributed.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "Expat License"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License",
                     "Modified BSD License", "BSD License", "The BSD License"],
    "Unlicense": ["The Unlicense", "Unlicense"],
}

#: Lines of an entire text that files of it often lack: its title, and the line at which an appendix begins.
TITLE_LINES = {"Apache-2.0": 3, "GPL-1.0-only": 2, "GPL-2.0-only": 2, "GPL-3.0-only": 2, "LGPL-2.0-only": 2, "LGPL-2.1-only": 2, "LGPL-3.0-only": 2,
               "MPL-1.1": 2, "MPL-2.0": 1, "CC0-1.0": 2, "CC-BY-SA-4.0": 1, "GFDL-1.3-only": 2}
APPENDIX = ("appendix: how to apply", "how to apply these terms", "addendum: how to use", "exhibit a")
ADDRESSES = ["51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA",
             "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA"]

#: The two and three clauses, by numbering of the clauses, by name in the third, and by who provides the software.
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:
{0}Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
{1}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution.
{2}THIS SOFTWARE IS PROVIDED BY THE {3} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE {4} BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT
OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_THIRD = """Neither the name of {0} nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission.
"""
BSD_NAMES = ["the copyright holder", "the copyright holders", "the University", "the author", "the project", "the organization", "the <organization>"]
BSD_PARTIES = [("COPYRIGHT HOLDERS AND CONTRIBUTORS", "COPYRIGHT HOLDER OR CONTRIBUTORS"), ("COPYRIGHT HOLDERS AND CONTRIBUTORS", "COPYRIGHT HOLDERS OR CONTRIBUTORS"),
               ("REGENTS AND CONTRIBUTORS", "REGENTS OR CONTRIBUTORS"), ("AUTHOR AND CONTRIBUTORS", "AUTHOR OR CONTRIBUTORS"),
               ("AUTHORS AND CONTRIBUTORS", "AUTHORS OR CONTRIBUTORS"), ("AUTHOR", "AUTHOR")]


def _bsd() -> list[tuple[str, str]]:
    out = []
    for one, two, three in (("1. ", "2. ", "3. "), ("(1) ", "(2) ", "(3) "), ("a. ", "b. ", "c. "), ("* ", "* ", "* ")):
        for party in BSD_PARTIES:
            out.append(("BSD-2-Clause", BSD.format(one, two, "", *party)))
            out += [("BSD-3-Clause", BSD.format(one, two, three + BSD_THIRD.format(name), *party)) for name in BSD_NAMES]
    return out


def _whole(name: str, text: str) -> list[str]:
    """An entire text as published, and without its title, its appendix or both; with the former addresses of its steward."""
    lines = text.strip("\n").split("\n")
    at = next((k for k, x in enumerate(lines) if x.strip().lower().startswith(APPENDIX)), len(lines))
    title = [k for k, x in enumerate(lines) if any(map(str.isalnum, x))][TITLE_LINES[name]]
    cuts = ["\n".join(lines[lo:hi]) for lo in (0, title) for hi in {at, len(lines)}]
    have = next((a for a in ADDRESSES if a in " ".join(text.split())), None)
    narrow = ["\n".join(" ".join(x.split()) for x in cut.split("\n")) for cut in cuts]
    return narrow if have is None else [cut.replace(have, other) for cut in narrow for other in ADDRESSES]


def _known() -> list[tuple[str, str]]:
    short = SHORT + _bsd()
    # a licence of several paragraphs is a text to which a title belongs; notices of one line have none
    titled = [(name, f"{title}\n\n{text}") for name, text in short if "\n" in text for title in TITLES.get(name, ())]
    return short + titled + [(name, t) for name, text in TEXTS.items() for t in _whole(name, text)]


#: All licences and notices that are known from the start, by SPDX identifier.
KNOWN = _known()

#: A line that begins with "copyright" and a year, sign or placeholder, or that is "copyright" and a holder: up to five words, of which
#: the last ends in a letter, digit or ">", or names a company or group.  Lines of running text are longer or end a sentence.
NAME = r"[\p{L}<][\p{L}\p{N}'’.,&@<>_+-]*"
COPYRIGHT_LINE = (
    r"(^|\n)[^\n\p{L}\p{N}]*(copyright[ \t]*(\(c\)|©|[0-9]|<|\[)|©|\(c\)|"
    rf"copyright[ \t]+(by[ \t]+)?({NAME}[ \t]+){{0,4}}([\p{{L}}<]|{NAME}[\p{{L}}\p{{N}}>]|inc\.|ltd\.|co\.|corp\.)"
    r"([ \t.,]+all rights reserved\.?)?[ \t\r]*(?m:$))[^\n]*")
RESERVED = r"all rights reserved\.?"
NEITHER = r"[^\p{L}\p{N}\n]+"


def levelled(text: str | Column) -> Column:
    """The text with each line in canonical form, lines still apart; each line has a space at both ends."""
    text = F.col(text) if isinstance(text, str) else text
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "$1")
    out = F.regexp_replace(out, RESERVED, "")
    out = F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(out, NEITHER, " "), r" *\n *", " \n "), F.lit(" "))
    for have, want in SPELLINGS.items():
        out = F.replace(out, F.lit(" " + have), F.lit(" " + want))
    return out


def canonical(text: str | Column) -> Column:
    """One line of lower-case words, one space apart; empty for NULL and for texts without letters and digits."""
    return F.trim(F.regexp_replace(levelled(text), r"[ \n]+", " "))


def known_digests(known: DataFrame) -> DataFrame:
    """license_id, digest of a table (license_id, text); equal digests keep the first identifier by name.

    Texts without a letter or digit, and NULL identifiers, are no licences and are left out.
    """
    words = known.select(known["license_id"].alias("license_id"), canonical(known["text"]).alias("words"))
    return words.where("words <> '' AND license_id IS NOT NULL").groupBy(F.sha2("words", 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def builtin(spark: SparkSession) -> DataFrame:
    quoted = ", ".join("('{}', '{}')".format(name, text.replace("\\", "\\\\").replace("'", "\\'")) for name, text in KNOWN)
    return spark.sql(f"SELECT * FROM VALUES {quoted} AS known(license_id, text)")


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, unit, digest, license_id: unit 0 is the entire text of each document (license_id NULL if it is no known
    licence); unit k is its k-th line, present only if that entire line is a known licence or notice.

    The digest of unit 0 has one space for each line break; licences are matched without regard to the number of breaks, so
    that blank lines and removed copyright lines between paragraphs do not count.
    NULL, empty and wordless texts have the digest of the empty form and no licence.  A text of one line is
    judged as unit 0 and as unit 1.  Equal rows give equal results for each row.  The planner broadcasts the
    digests if it knows them to be small, and else shuffles both sides by digest.
    """
    digests = known_digests(builtin(docs.sparkSession) if known is None else known)
    # the levelled text is named, so that it is computed once for the text and its lines
    level = docs.select(docs["doc_id"].alias("doc_id"), levelled(docs["text"]).alias("lines"))
    entire = F.array(F.trim(F.regexp_replace("lines", r" *\n *", " ")))
    units = level.select("doc_id", F.posexplode(F.concat(entire, F.split("lines", "\n"))).alias("unit", "words"))
    units = units.select("doc_id", "unit", F.trim("words").alias("words")).where("unit = 0 OR words <> ''")
    hashed = units.select("doc_id", "unit", F.sha2("words", 256).alias("digest"), F.sha2(F.regexp_replace("words", " +", " "), 256).alias("known_digest"))
    found = hashed.join(digests.withColumnRenamed("digest", "known_digest"), "known_digest", "left")
    return found.where("unit = 0 OR license_id IS NOT NULL").select("doc_id", "unit", "digest", "license_id")
