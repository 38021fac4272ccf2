"""License scans: canonical texts joined by digest to known licences, with built-in functions only.

A text is made canonical (lower case, equivalent spellings, copyright lines dropped, punctuation and white space folded)
and the digest of all of it is hash-joined to the digests of known licence texts. The same canonical form of each of its
lines is looked up among the digests of known notices, so that a document which carries a notice is found as well. Only
lines with a word that some notice needs are looked up; these words are derived from the list, so none of it is lost.
Known digests are a fixed list of this module (a few kilobytes), which is why it may be broadcast; others can be passed in.

Defined cases: null, empty and punctuation-only texts have the digest of the empty text and match nothing. Equal texts
get equal rows, one per row of the input. Of known texts with one digest the least name counts. A very long text is one
row of built-in string functions. Other columns are not looked at, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that count as one, as whole words: found, put in place. Applied in this order.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("organisation", "organization"),
    ("favour", "favor"), ("honour", "honor"), ("judgement", "judgment"), ("acknowledgement", "acknowledgment"), ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"), ("copyright holder", "copyright owner"), ("copyright holders", "copyright owners"), ("sub license", "sublicense"),
    ("http", "https"), ("v2", "version 2"), ("v3", "version 3"),
]
#: Lines that name an owner, not terms.
COPYRIGHT_LINE = r"(?i)(^|\n)[^a-z0-9\n]*(copyright|\(c\)|©)[^\n]*[0-9]{4}[^\n]*"
#: The same without a year, where a sign, `by` or a blank to fill in shows that an owner follows.
OWNER_LINE = r"(?i)(^|\n)[^a-z0-9\n]*(copyright\s*(\(c\)|©|by\s|[\[{<])|\(c\)\s*copyright|©)[^\n]*"
ALL_RIGHTS = r"(?i)all rights reserved\.?"

#: Notices by which a document says what it is licensed under.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This work is licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
]

#: Usual header lines and identifiers beyond NOTICES.
MORE_NOTICES = [
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MPL-2.0", "License, v. 2.0. If a copy of the MPL was not distributed with this"),
    ("MIT", "This project is licensed under the MIT License."),
    *[(x, f"SPDX-License-Identifier: {x}") for x in (
        "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-or-later",
        "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MPL-2.0", "Unlicense", "Zlib",
    )],
]

#: Whole licence texts, without their copyright lines.
TEXTS = [
    ("MIT", """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <http://unlicense.org/>"""),
]


_BSD = dict(TEXTS)["BSD-2-Clause"]
_CLAUSE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
MORE_TEXTS = [("BSD-3-Clause", _BSD.replace("THIS SOFTWARE IS", _CLAUSE + "THIS SOFTWARE IS", 1))]

#: Digests of long texts, as published by their stewards, and of those up to the end of their terms.
DIGESTS = [
    ("Apache-2.0", "a07a98abe6316c22d88c9cd2e61b8796f468228e21e01ffd092d00377ceb18ad"),
    ("Apache-2.0", "b3d1d5e7912ec4082474f3b926a0a1626b01ee68700abab5bd37a6a069dea949"),
    ("Apache-2.0", "9c2eee933f32520b2af08f604fed2c16b1aab2f6ca481f0b0be26ab3cc01279a"),
    ("CC0-1.0", "bd0e52fb1af40ab9797ba72f1d627b83d449e9926f66d21c51209413ac988137"),
    ("GPL-1.0", "51f6c6a5ff6c063c64e503d81600b9a11abe2a18b22919405e5ef75f58587a4e"),
    ("GPL-1.0", "5b5f6b7d5c41229dd1d745a937f4f758657bb1465a7a04aade6b7047192be62c"),
    ("GPL-1.0", "4fc14f1f1bbe17479d630633a17882b8e98b3859320b5990aba9096b0c8991b6"),
    ("GPL-2.0", "c84365328b2d2b91e5f69e54ff5c7a2841c5f45ce5d2d0fed15e313767625c97"),
    ("GPL-2.0", "d15487a7a256126feffcab95dedfdc11e67a161fb2a15608933d9bc69f015912"),
    ("GPL-2.0", "fbf056e22599ca018979deb2324fd353404bb7f6228cf1b9eead9dbe0f81bade"),
    ("GPL-3.0", "dd95cb03d51e35030b891a0e5aa4f92bfd10ed933b7fcde61739c2c4f7c61c12"),
    ("GPL-3.0", "304dd0c04da41ff0c6ff22a69390bfd3a1bce74de5588df7f4769134e8ae9b8d"),
    ("GPL-3.0", "dc96e83fc88f923c67536ade8860bc9f5cfd365d2c896650fad7192579660218"),
    ("LGPL-2.0", "351e0150eb84acce8401ceae774dea5b1f0b347ddbfcd33ae651b815ef9d1b99"),
    ("LGPL-2.0", "6ad1896e755e60d4edb5f213ae967a48388fbeeea2c1547cdbefceae453e275f"),
    ("LGPL-2.0", "7a70e0f279adb7b044f5f26384aaae21f845850e0aedb0f46d809d295d4875af"),
    ("LGPL-2.1", "ba3300d9fef3de057a59e52385eeea2120c919091871878af1bd75a879f1577c"),
    ("LGPL-2.1", "6ae050ea59d51d2e1a6abd9026eabe29c045e4b04a245b89362f0a41da6437b0"),
    ("LGPL-2.1", "f851d1b94962a6511c8dbe306fdefdce00aa5ba36edcf937c22a0f15bd3ad570"),
    ("LGPL-3.0", "f0cae4b317f4f263dca8e79625f8d9c7618c87e0ca6665c79b0f1c12ac856938"),
    ("MPL-1.1", "0ac61f2f49b44016379e89eb6a869e098cdbe0a797cf497618f3e8de3adaf375"),
    ("MPL-2.0", "b37263b1b2fae7b22e0bbbd4e1ef00041bda6d7c8df0fee3633b1f0362b35b7b"),
    ("Artistic-1.0-Perl", "769a23e410c4f803d54220c62ba3d2244f614ef4a2aff6ca678973a843dc8c28"),
    ("GFDL-1.2", "5809790eadcf1dc4aa6cfe3eccd3cdc2a5799b0110d6664aba551c63503bd8cd"),
    ("GFDL-1.3", "e122d6500129e9c865e4531fd53d5892d888d7cf12a04b56ed3cddc2cb9e5844"),
    ("BSD-3-Clause", "48c8a35a4353dae3524b849cfd2c781b3c935e964f465e15fb0bc23f23cf96ad"),
]


#: What lies between words while spellings are replaced: two spaces, so that each word has its own on both sides.
_BETWEEN = "  "


def _spelled(x: str) -> str:
    return f" {x.replace(' ', _BETWEEN)} "


def canonical(text: Column) -> Column:
    """The canonical form of a text: words of letters and digits with one space between and around."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), COPYRIGHT_LINE, "$1"), OWNER_LINE, "$1"), ALL_RIGHTS, "")
    out = F.regexp_replace(F.concat(F.lit(" "), F.lower(plain), F.lit(" ")), r"[^\p{L}\p{N}]+", _BETWEEN)
    for found, put in SPELLINGS:
        out = F.replace(out, F.lit(_spelled(found)), F.lit(_spelled(put)))
    return F.regexp_replace(out, " +", " ")


def needed_words(notices: list[tuple[str, str]]) -> str:
    """A pattern that each notice's line holds in lower case: a few words that cover the list, in all their spellings."""
    left = [set(re.findall(r"[^\W_]+", re.sub(COPYRIGHT_LINE, "", n).lower())) for _, n in notices]
    put = {f: p for f, p in SPELLINGS if " " not in f + p}
    left = [{put.get(w, w) for w in ws} for ws in left]
    chosen = []
    while left:
        best = max(sorted({w for ws in left for w in ws}), key=lambda w: (sum(w in ws for ws in left), len(w)))
        chosen.append(best)
        left = [ws for ws in left if best not in ws]
    spelled = {w for best in chosen for w in [best, *(x for f, p in SPELLINGS if best in p.split() for x in f.split())]}
    return "|".join(sorted(spelled))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def table_of(spark: SparkSession, pairs: list[tuple[str, str]], value: str = "text") -> DataFrame:
    """(license, text) of a fixed list."""
    fixed = F.array(*[F.struct(F.lit(of).alias("license"), F.lit(t).alias(value)) for of, t in pairs])
    return spark.range(0, 1, 1, 1).select(F.inline(fixed))


def known(texts: DataFrame, name: str) -> DataFrame:
    """One row a digest of known texts (license, text): the least name."""
    return texts.groupBy(digest(F.col("text")).alias(f"{name}_digest")).agg(F.min("license").alias(name))


def scan(docs: DataFrame, text: str = "text", texts: DataFrame | None = None, notices: DataFrame | None = None) -> DataFrame:
    """doc_id, digest, text_license (null: unknown), notices (sorted licences of its lines), n_notices of every row.

    Known texts and notices can be passed in as tables (license, text) in place of the fixed lists; notices end up in one
    map that every task holds.
    """
    spark = docs.sparkSession
    if texts is None:
        long = table_of(spark, DIGESTS, "text_license_digest").select("text_license_digest", F.col("license").alias("text_license"))
        found_in = F.broadcast(known(table_of(spark, TEXTS + MORE_TEXTS), "text_license").unionByName(long))  # fixed list
    else:
        found_in = known(texts, "text_license")
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    if notices is None:
        lines = F.filter(lines, lambda x: F.regexp_like(F.lower(x), F.lit(needed_words(NOTICES + MORE_NOTICES))))
        looked_up = F.create_map(*[x for of, n in NOTICES + MORE_NOTICES for x in (F.sha2(canonical(F.lit(n)), 256), F.lit(of))])
        source = docs
    else:
        pairs = known(notices, "notice").agg(F.map_from_entries(F.collect_list(F.struct("notice_digest", "notice"))).alias("known_notices_"))
        looked_up = F.col("known_notices_")
        source = docs.crossJoin(F.broadcast(pairs))  # one row
    hits = F.array_compact(F.transform(lines, lambda x: F.try_element_at(looked_up, digest(x))))
    rows = source.select("doc_id", digest(F.col(text)).alias("digest"), hits.alias("found"))
    joined = rows.join(found_in, rows["digest"] == found_in["text_license_digest"], "left")
    return joined.select("doc_id", "digest", "text_license", F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("notices"), F.size("found").alias("n_notices"))


def oracle() -> str:
    """DuckDB SQL with the rows of scan() over documents."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"

    def canonical_sql(x: str) -> str:
        out = f"regexp_replace(regexp_replace(regexp_replace(coalesce({x}, ''), {quoted(COPYRIGHT_LINE)}, '\\1', 'g'), {quoted(OWNER_LINE)}, '\\1', 'g'), {quoted(ALL_RIGHTS)}, '', 'g')"
        out = f"regexp_replace(' ' || lower({out}) || ' ', '[^\\p{{L}}\\p{{N}}]+', '{_BETWEEN}', 'g')"
        for found, put in SPELLINGS:
            out = f"replace({out}, '{_spelled(found)}', '{_spelled(put)}')"
        return f"sha256(regexp_replace({out}, ' +', ' ', 'g'))"

    values = lambda pairs: ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in pairs)
    return f"""
with texts as (select min(license) as license, {canonical_sql("text")} as digest from (values {values(TEXTS + MORE_TEXTS)}) v(license, text) group by 2 union all select license, digest from (values {values(DIGESTS)}) v(license, digest)),
notices as (select min(license) as license, {canonical_sql("text")} as digest from (values {values(NOTICES + MORE_NOTICES)}) v(license, text) group by 2),
d as (select row_number() over () as r, doc_id, text, {canonical_sql("text")} as digest from documents),
l as (select r, unnest(string_split(coalesce(text, ''), chr(10))) as line from d),
h as (select r, {canonical_sql("line")} as digest from l where regexp_matches(lower(line), {quoted(needed_words(NOTICES + MORE_NOTICES))})),
n as (select r, array_to_string(list_sort(list_distinct(list(license))), ',') as notices, count(*)::int as n_notices from h join notices using (digest) group by r)
select d.doc_id, d.digest, texts.license as text_license, coalesce(n.notices, '') as notices, coalesce(n.n_notices, 0)::int as n_notices
from d left join texts on d.digest = texts.digest left join n on d.r = n.r"""
