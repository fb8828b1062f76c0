r"""Licence scans by canonical digest (operator 4), in DataFrame functions only.

A text is brought to a canonical form and its SHA-256 looked up among the digests of
known licence texts:

1. letters become lower case; typographic quotes and dashes count as punctuation;
2. lines that start as a copyright notice, and lines saying that all rights are
   reserved, are dropped; a wrapped line of a licence that begins with "copyright notice",
   "copyright holders" and the like is none (``NO_NOTICE``);
3. equivalent spellings become one (``SPELLINGS``; those of several words once the lines are joined);
4. every run of characters that are not a letter, a digit or beyond ASCII becomes one space.

Both the entire text and each of its paragraphs and lines are looked up: an entire
text that is a licence is a licence file, a line or paragraph that is one in
full is a notice inside a document.

The known digests come from a caller's table (``license_id``, ``text``), or from
``KNOWN`` and ``KNOWN_DIGESTS``. The hash join broadcasts them only while they are few
(``broadcast_rows``); beyond that Spark joins by shuffle.

Defined cases: a null or empty text has the digest of the empty string and no licence;
repeated (id, text) rows give one result row; a null id stays; an empty table gives an
empty result; other columns are not read. Where two known licences have one canonical
form the smallest id is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm.common import documents

# Equivalent spellings as the public licence-matching guidelines list them.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"),
    ("cancelled", "canceled"), ("capitalisations", "capitalizations"), ("catalogue", "catalog"),
    ("categorise", "categorize"), ("centre", "center"), ("emphasised", "emphasized"), ("favour", "favor"),
    ("favourite", "favorite"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("initialise", "initialize"),
    ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"),
    ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"), ("offence", "offense"),
    ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"),
    ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"),
    ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willfull"), ("noncommercial", "non commercial"),
    ("sublicence", "sublicense"), ("sub license", "sublicense"), ("https", "http"),
)

# Short public licence texts and the usual notices.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZERO_BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
KNOWN = (
    ("MIT", _MIT), ("MIT", "MIT License\n" + _MIT), ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("ISC", _ISC), ("ISC", "ISC License\n" + _ISC),
    ("0BSD", _ZERO_BSD), ("0BSD", "BSD Zero Clause License\n" + _ZERO_BSD),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL), ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC0-1.0", "Released under CC0 1.0."),
    ("MIT", "SPDX-License-Identifier: MIT"), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
)

# Digests of the canonical forms of longer public licence texts, as Debian's base system ships them
# (Apache-2.0 also without its appendix, with and without the line that ends its terms).
KNOWN_DIGESTS = (
    ("Apache-2.0", "37599287c15c2f2ec060c3c3b55bdf69e3bc7a8aeeb9cd57e18800088789538a"),
    ("Apache-2.0", "e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2"),
    ("Apache-2.0", "f45538b138cf9aea39fa205de037a0bede8305e68281650e7ab809a8b3ebb2f0"),
    ("Artistic-1.0-Perl", "d1ce9579b2c8d32b706b421d9c42208152298e00849e57ce7da8e906ed3802f2"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GPL-1.0", "9caf042595280548f0149ac88169a7f2e04f35b2a642cf00b991f00d48bfa4ce"),
    ("GPL-2.0", "331b500eb3c5ee796906547305df82fff4a35b3aa03c1d3ea84d32078292b2e6"),
    ("GPL-3.0", "9085ee283b8c84517846c5acafee37391c28bb825b7ecec4aaa90768f2f283b0"),
    ("LGPL-2.0", "5b313222545879140519fc4f8ac7558088e9529f29bda08d2b75946987652f50"),
    ("LGPL-2.1", "6ce9e9dc5005db9536b303ace5104e7d79eb77fa76f5ca2e335ea6401497ea1e"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "fcb579371133afd771fed87cd5d8c6dc5648746c9945d4adf08ec5c79aba5c61"),
    ("MPL-2.0", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
)

# Words behind "copyright" or "(c)" that make it a part of a sentence or a list, not a notice.
NO_NOTICE = (r"(?:notices?|holders?|owners?|owned|ownership|licen[cs]es?|licen[cs]ed|laws?|statements?|interests?|disclaimers?|protection|"
             r"rights?|treaty|patents?|and|or|in|is|of|on|to|for|as|that|which|you|if|any)\b")
COPYRIGHT_LINE = rf"(?m)^[^a-z0-9\n]*(copyright(?![^a-z0-9]*{NO_NOTICE})|\(c\)(?! *{NO_NOTICE})|©)[^\n]*$"
RESERVED_LINE = r"(?m)^[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*$"
NOT_A_WORD = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F‘’‚“”„–—‐‑]+"  # all but the line feed


_SPELLED = r"(?:^|[ \n])(" + "|".join(s for s, _ in SPELLINGS) + r")(?:[ \n]|$)"


def canonical_lines(df: DataFrame, col: str, out: str) -> DataFrame:
    """``df`` with the canonical form of column ``col`` as ``out``, its lines still apart; null becomes the
    empty string.

    Two steps, so that the plain form is computed once though the spelling step reads it three times:
    few texts hold any of the spellings, and only those are taken apart into words.
    """
    t = F.lower(F.coalesce(F.col(col), F.lit("")))
    t = F.regexp_replace(F.regexp_replace(t, COPYRIGHT_LINE, ""), RESERVED_LINE, "")
    names = F.create_map(*(F.lit(x) for pair in SPELLINGS for x in pair))
    words = F.transform(F.split(F.replace(F.col(out), F.lit("\n"), F.lit(" \n ")), " "),
                        lambda w: F.coalesce(F.try_element_at(names, w), w))
    return df.withColumn(out, F.regexp_replace(t, NOT_A_WORD, " ")).withColumn(
        out, F.when(F.col(out).rlike(_SPELLED), F.array_join(words, " ")).otherwise(F.col(out)))


def joined(form: Column) -> Column:
    """The canonical form of lines taken together: one space between words, and spellings of several words made one."""
    out = F.trim(F.regexp_replace(form, r"[ \n]+", " "))
    for spelling, usual in SPELLINGS:
        if " " in spelling:
            out = F.regexp_replace(out, f"(?<![^ ]){spelling}(?![^ ])", usual)
    return out


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(KNOWN), "license_id string, text string")


def digests(known: DataFrame) -> DataFrame:
    """Digest and licence, one row per digest; texts without a word are left out."""
    form = canonical_lines(known.select("license_id", "text"), "text", "form").withColumn(
        "form", joined(F.col("form"))).where("form != '' and license_id is not null")
    return form.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def known_digests(spark: SparkSession) -> DataFrame:
    """The digests of the default list, one row per digest."""
    longer = spark.createDataFrame(list(KNOWN_DIGESTS), "license_id string, digest string")
    return digests(known_licenses(spark)).unionByName(longer).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, broadcast_rows: int = 100_000,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``text_digest``, ``license_id`` of the entire text, ``n_notices`` (units
    inside it that are a known text in full, each distinct one once) and ``notice_ids``.

    Every document is cut into its units in the task that reads it; units meet the digests in a
    broadcast hash join whose small side is counted first, so only one row per document is
    shuffled after partial aggregation.
    """
    table = digests(known) if known is not None else known_digests(docs.sparkSession)
    few = table.limit(broadcast_rows + 1).count() <= broadcast_rows
    form = F.col("form")
    lines = canonical_lines(documents(docs, id_col, text_col), "text", "form").select("doc_id", "form")
    parts = lines.select("doc_id", joined(form).alias("entire"), F.array_distinct(F.transform(
        F.concat(F.split(form, "\n"), F.split(form, r"\n[ \n]*\n")), joined)).alias("parts"))
    units = parts.select("doc_id", F.sha2("entire", 256).alias("text_digest"), F.explode_outer(F.transform(
        F.filter("parts", lambda p: (p != F.col("entire")) | (p == "")), lambda p: F.sha2(p, 256))).alias("digest"))
    small = F.broadcast(table) if few else table
    found = units.join(small, "digest", "left").groupBy("doc_id", "text_digest").agg(
        F.count("license_id").alias("n_notices"),
        F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notice_ids"))
    return found.join(small.withColumnRenamed("digest", "text_digest"), "text_digest", "left").select(
        "doc_id", "text_digest", "license_id", "n_notices", "notice_ids")
