"""License scans by canonical digest: whole texts, and lines, whose canonical form has the digest of a known license or notice."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage

#: Spellings that license matching treats as equal, applied to lower-case text in this order.
SPELLINGS = (
    ("licence", "license"), ("licencing", "licensing"), ("sub-license", "sublicense"),
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"), ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"),
    ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfilment", "fulfillment"),
    ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("maximise", "maximize"),
    ("modelled", "modeled"), ("modelling", "modeling"), ("non-commercial", "noncommercial"), ("offence", "offense"), ("optimise", "optimize"),
    ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"),
    ("recognise", "recognize"), ("signalling", "signaling"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
    ("https:", "http:"), ("&", " and "),
)

#: The same for phrases of two words, which a line end may part; applied once blanks are single.
PHRASES = (("copyright holder", "copyright owner"), ("sub license", "sublicense"), ("per cent", "percent"))

#: Texts of licenses.
LICENSES = {
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
}

LICENSES["BSD-3-Clause"] = LICENSES["BSD-2-Clause"].replace(
    "\nTHIS SOFTWARE",
    "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\nTHIS SOFTWARE",
)
LICENSES["Unlicense"] = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>"""

#: Title lines that often head a license's text; its text matches with each of them and without.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (Expat)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "BSD-0-Clause License", "Zero-Clause BSD License"),
    "Zlib": ("zlib License", "The zlib License", "The zlib/libpng License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License", "BSD 2-Clause \"Simplified\" License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License", "Modified BSD License", "BSD 3-Clause \"New\" or \"Revised\" License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}

#: Digests of the canonical forms of longer published texts (whole files, titles included; copyright lines never count).
DIGESTS = {
    "95f35d79ea3bab75c250549d6a03cef242e0547d78c99e26fcede49936fb0184": "Apache-2.0",
    "64e91f5cc481723b420f8e1ecf131ec7eba02da96cf0a78bb4b764fb30984f7a": "Artistic-1.0-Perl",
    "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f": "CC0-1.0",
    "66919c3537107c2c9f5219f6ba4c41fe9c0d7c14d885087e3db69494463a778e": "GFDL-1.2",
    "525fd4384869c81c4cbd264822942ae15202284aed28fb120ba01fc119dda9ff": "GFDL-1.3",
    "9afd2a0837407af373a8d2fd5fa246e7ab95ded1f8b20bde740e7c7c1525cd70": "GPL-1.0",
    "39fd2d64822d059bba18173590e22f9d95d836209aef6efd30b983b346aa4354": "GPL-2.0",
    "6fbe9ba081ea7329eeee78176dded7a73d43ee2eb9574a683988634e96aa3c31": "GPL-3.0",
    "8e8ffd5752111302160e6ee7d7d229c3ff9fc6431363cfc44be8cfd0f64c24c6": "LGPL-2.0",
    "5ce6fa0934cb8db1e96d36322f81fd98d11cc658ec86c71b9519d9c723a13041": "LGPL-2.1",
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0",
    "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6": "MPL-1.1",
    "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a": "MPL-2.0",
}

#: One-line notices that name a license.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

#: A line that only claims rights (one that begins with "copyright" and has a sign or a year, too); not part of any license's
#: canonical form. For re, Java and RE2 alike, on lower-case text.
RIGHTS = r"(^|\n)[^a-z0-9\n]*(copyright[^a-z0-9\n]*(c\)|©|[0-9])|copyright [^\n]*[12][0-9][0-9][0-9]|(c\)|©)[^a-z\n]*[0-9]|all rights reserved)[^\n]*"


def canonical(text: str) -> str:
    """The same as canonical_column, in Python, for the tables of known digests and tests."""
    out = " ".join(x for x in re.split("[ \n]+", _plain(text)) if x)
    for a, b in PHRASES:
        out = out.replace(a, b)
    return out


def _plain(text: str) -> str:
    text = text.lower()
    for a, b in SPELLINGS:
        text = text.replace(a, b)
    return re.sub(r"[^a-z0-9\n\x80-\U0010ffff]+", " ", re.sub(RIGHTS, r"\1", text))


def digest(text: str) -> str:
    return hashlib.sha256(canonical(text).encode()).hexdigest()


def known_digests() -> dict[str, str]:
    """License by digest, of full texts with and without a title line, longer published texts, and notices."""
    texts = [(name, title + text) for name, text in LICENSES.items() for title in ("", *(f"{t}\n" for t in TITLES.get(name, ())))]
    return {digest(t): name for name, t in [*texts, *NOTICES.items()]} | DIGESTS


def _plain_column(text: Column) -> Column:
    out = F.lower(F.coalesce(text, F.lit("")))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(out, RIGHTS, "$1"), r"[^a-z0-9\n\x{80}-\x{10ffff}]+", " ")


def _digest_column(plain: Column) -> Column:
    out = F.trim(plain)
    for a, b in PHRASES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.sha2(out.cast("binary"), 256)


def known_table(spark: SparkSession) -> DataFrame:
    """canonical_sha256, license_id: one row for each text in this module."""
    return spark.createDataFrame(sorted(known_digests().items()), "canonical_sha256 string, license_id string")


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, canonical_sha256, license_id, notices: a row for each row of docs.

    license_id is that of the license whose canonical text is the whole canonical text of the document, else null.
    notices has the licenses of lines with a known digest, distinct and in order, joined by commas ('' if none). Copyright
    lines, case, punctuation, blanks and the SPELLINGS don't count. A null text is empty, an empty one matches nothing.
    known (canonical_sha256, license_id; of a repeated digest the least id counts, digests without a license are left out) may have any
    size: texts and lines find it by joins, which Spark broadcasts only if its size allows. Ids pass through; other columns are not read.
    """
    spark = docs.sparkSession
    stage = Stage(spark)
    known = (known_table(spark) if known is None else known).filter("canonical_sha256 is not null and license_id is not null")
    known = known.groupBy(F.unhex("canonical_sha256").alias("digest")).agg(F.min("license_id").alias("license_id"))
    plain = docs.select(F.col(id_col).alias("doc_id"), _plain_column(F.col(text_col)).alias("plain"))
    lines = F.filter(F.transform(F.split("plain", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = plain.select(
        "doc_id", F.unhex(_digest_column(F.regexp_replace("plain", "[ \n]+", " "))).alias("digest"),
        F.unhex(F.sha2(F.col("plain").cast("binary"), 256)).alias("key"), F.transform(lines, lambda x: F.unhex(_digest_column(x))).alias("lines"),
    )
    rows = stage.write(rows, "digests", scan=True)
    found = rows.select("key", F.explode("lines").alias("digest")).join(known, "digest").groupBy("key", "license_id").agg(F.lit(1).alias("_one"))
    found = found.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("license_id")), ",").alias("notices"))
    whole = rows.select("doc_id", "digest", "key").join(known, "digest", "left").join(found, "key", "left")
    return whole.select("doc_id", F.lower(F.hex("digest")).alias("canonical_sha256"), "license_id", F.coalesce("notices", F.lit("")).alias("notices"))


def scan_sql() -> str:
    """scan() over documents, for DuckDB."""
    text = "lower(coalesce(text, ''))"
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    for a, b in SPELLINGS:
        text = f"replace({text}, {quote(a)}, {quote(b)})"
    rights = RIGHTS.replace("\\n", "\n")
    plain = f"regexp_replace(regexp_replace({text}, {quote(rights)}, '\\1', 'g'), '[^a-z0-9\n\\x{{80}}-\\x{{10ffff}}]+', ' ', 'g')"

    def sha(plain: str) -> str:
        for a, b in PHRASES:
            plain = f"replace({plain}, {quote(a)}, {quote(b)})"
        return f"sha256({plain})"

    values = ", ".join(f"({quote(d)}, {quote(n)})" for d, n in sorted(known_digests().items()))
    return f"""
        WITH known(digest, license_id) AS (VALUES {values}),
        plain AS (SELECT doc_id, {plain} AS plain FROM documents),
        lines AS (SELECT doc_id, unnest(string_split(plain, '\n')) AS line FROM plain),
        found AS (SELECT doc_id, array_to_string(list_sort(list_distinct(list(license_id))), ',') AS notices
                  FROM lines JOIN known ON digest = {sha('trim(line)')} GROUP BY doc_id)
        SELECT doc_id, canonical_sha256, license_id, coalesce(notices, '') AS notices
        FROM (SELECT doc_id, {sha("trim(regexp_replace(plain, '[ " + chr(10) + "]+', ' ', 'g'))")} AS canonical_sha256 FROM plain)
        LEFT JOIN known ON digest = canonical_sha256 LEFT JOIN found USING (doc_id)"""
