"""Licence scan by canonical digests, in DataFrame functions only.

A text is canonical once it is lower-cased, freed of copyright lines and of title
lines at its head, has punctuation turned to spaces, equivalent spellings made
one, and white space collapsed. The SHA-256 of the whole canonical text is joined
to the digests of known licence texts, which are listed with and without the
appendix that tells how to apply them; each canonical line of the text is looked up the same way
among known one-line notices.

Defined cases: a null text is an empty one, whose digest matches nothing; every
row gives one row, repeated ids included; known texts that become equal are one
licence, the smallest id; very long texts are canonicalised whole; columns other
than id and text are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import pkgutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Title lines of licences and addresses of their heads, in lower case.
_TITLES = "|".join((
    r"(?:the )?mit license(?: \(mit\))?", r"(?:the )?isc license(?: \(isc\))?", r"(?:the )?zlib license", r"boost software license - version 1\.0 - august 17th, 2003", r"mit no attribution", r"(?:the )?unlicense", r"(?:bsd )?zero[ -]clause (?:bsd|license)(?: license)?(?: \(0bsd\))?",
    r"(?:the )?bsd [23][ -]clause(?: \"simplified\"| \"new\" or \"revised\")? license", r"apache license(?:,? version 2\.0)?(?:, january 2004)?", r"version 2\.0, january 2004",
    r"https?://www\.apache\.org/licenses/?", r"gnu general public license(?:,? version [23])?", r"version 3, 29 june 2007", r"version 2, june 1991", r"mozilla public license,? version 2\.0",
    r"(?:51 franklin st|59 temple place)[^\n]*",
))
#: The head of a text as far as it's titles and copyright lines; only there a plain ``copyright <name>`` is one, as wrapped lines of a licence begin so too.
_HEAD = r"^(?:[ \t\r\n*#/;=-]*(?:(?:" + _TITLES + r")[ \t\r*/.:=-]*|(?:copyright|\(c\)|©|all rights reserved)[^\n]*)(?:\n|$)){1,20}"
#: Titles at the head, and lines that state a copyright, after comment marks.
COPYRIGHT = _HEAD + r"|(^|\n)[ \t*#/;-]*(copyright[ \t]*(\(c\)|©|[0-9<\[])|\(c\)[ \t]|©|all rights reserved)[^\n]*"
#: ASCII that is no letter, digit or line end.
PUNCTUATION = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"
#: Equivalent spellings, applied in this order to canonical words; fixed values.
SPELLINGS = (
    ("licenc", "licens"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("copyright owner", "copyright holder"),
    ("https ", "http "), ("organisation", "organization"), ("favour", "favor"), ("acknowledgement", "acknowledgment"),
    ("merchantibility", "merchantability"), ("per cent", "percent"),
)
#: Short version numbers, as words of their own.
VERSION = r"(^|[ \n])v ?([23])($|[ \n])"
#: The line after the terms and the headings of appendices that tell how to apply a licence.
_TERMS_END, _APPENDICES = "END OF TERMS AND CONDITIONS", ("APPENDIX: How to apply", "How to Apply These Terms")

#: Known licence texts, fixed values.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "MIT-0": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    **{i: pkgutil.get_data(__package__, f"license_texts/{i}.txt").decode() for i in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "MPL-2.0")},
}
#: Known one-line notices, fixed values.
NOTICES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
}


def canonical_lines(text: F.Column) -> F.Column:
    """The canonical text with its line ends."""
    t = F.lower(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(F.regexp_replace(t, COPYRIGHT, "\n"), PUNCTUATION, " ")
    for found, same in SPELLINGS:
        t = F.replace(t, F.lit(found), F.lit(same))
    return F.regexp_replace(t, VERSION, "$1version $2$3")


def canonical(lines: F.Column) -> F.Column:
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def forms(text: str) -> list[str]:
    """The text as it is and, if it has them, without its appendix and without the line after its terms."""
    out = [text]
    for mark in (*_APPENDICES, _TERMS_END):
        if mark in out[-1]:
            out.append(out[-1][: out[-1].rindex(mark)])
    return out


def known(spark: SparkSession, texts: dict[str, str], name: str = "license_id") -> DataFrame:
    """(digest, id) of licence texts in all their forms."""
    rows = spark.createDataFrame([(i, f) for i, t in texts.items() for f in forms(t)], "id string, text string")
    digest = F.sha2(canonical(canonical_lines(F.col("text"))).cast("binary"), 256)
    return rows.groupBy(digest.alias("digest")).agg(F.min("id").alias(name))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", texts: dict[str, str] = TEXTS, notices: dict[str, tuple[str, ...]] = NOTICES) -> DataFrame:
    """Per document: id, digest of the canonical text, license_id of the whole text or null, ids of its notice lines.

    The known digests are a fixed table of a few rows, so the join is a broadcast
    hash join and no text is shuffled.
    """
    lines = docs.select(F.col(id_col), canonical_lines(F.col(text_col)).alias("lines"))
    # canonical notices are literals: folded once, looked up by digest for lines of a notice's length only
    keys = [(F.trim(canonical(canonical_lines(F.lit(n)))), i) for i, each in sorted(notices.items()) for n in each]
    lengths = F.array(*(F.length(k) for k, _ in keys))
    digests, ids = F.array(*(F.sha2(k.cast("binary"), 256) for k, _ in keys)), F.array(*(F.lit(i) for _, i in keys))
    short = F.filter(F.transform(F.split("lines", "\n"), lambda x: F.trim(x)), lambda x: F.array_contains(lengths, F.length(x)))
    place = F.transform(short, lambda x: F.array_position(digests, F.sha2(x.cast("binary"), 256)).cast("int"))
    found = F.transform(F.filter(place, lambda p: p > 0), lambda p: F.element_at(ids, p))
    rows = lines.select(id_col, F.sha2(canonical(F.col("lines")).cast("binary"), 256).alias("digest"), F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("notices"))
    return rows.join(F.broadcast(known(docs.sparkSession, texts)), "digest", "left").select(id_col, "digest", "license_id", "notices")
