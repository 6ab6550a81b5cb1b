"""Tests that each operator does the whole job: published wordings, every row, every shard."""

from tests.llm.test_joins_and_rules import docs

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE."""
BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY
WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_3 = BSD_2.replace("THIS SOFTWARE IS PROVIDED", """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED""")
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
USE OR PERFORMANCE OF THIS SOFTWARE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
License at https://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under
the License."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy
of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
CC = "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."

#: Texts and the labels that templates give them.
PUBLISHED = [
    (MIT, {"mit-text"}), (BSD_2, {"bsd-2-clause-text"}), (BSD_3, {"bsd-3-clause-text"}), (ISC, {"isc-text"}), (APACHE, {"apache-2.0-notice", "apache-2.0-header"}),
    (APACHE.replace("Licensed under", "The ASF licenses this file to you under"), {"apache-2.0-notice", "apache-2.0-header"}),
    (GPL, {"gpl-3.0-notice", "gpl-3.0-header"}), (GPL.replace("version 3", "version 2"), {"gpl-2.0-notice", "gpl-2.0-header"}), (CC, {"cc-by-nc-4.0-notice"}),
    ('under a licensed under a <a rel="license" href="http://creativecommons.org/licenses/by-nc/4.0/">Creative Commons Attribution-NonCommercial 4.0', {"cc-by-nc-4.0-notice"}),
    (CC.replace("NonCommercial", "NonCommercial-ShareAlike"), {"cc-by-nc-sa-4.0-notice"}), ("licensed under the MIT license", {"mit-notice"}),
    ("modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3", {"gpl-3.0-notice"}),
    # One-line notices.
    ("released under the mit license", {"mit-notice"}), ("licensed under the gnu general public license version 3", {"gpl-3.0-notice"}), ("licensed under cc by nc 4 0", {"cc-by-nc-4.0-notice"}),
    # Near misses.
    (MIT[: MIT.index("THE SOFTWARE IS")], set()), (MIT.replace("free of charge", "for a fee"), set()), (BSD_3[: BSD_3.index("THIS SOFTWARE IS")], set()), (BSD_2.replace("must retain", "may drop"), set()),
    (ISC[: ISC.index("THE SOFTWARE IS")], set()), (APACHE[: APACHE.index("Unless")], {"apache-2.0-notice"}), (GPL[: GPL.index("You should")], {"gpl-3.0-notice"}),
    (GPL.replace("version 3", "version 4"), set()), (GPL.replace("GNU General", "GNU Lesser General"), set()), (CC.replace("4.0", "2.0"), set()), ("licensed under the MITRE license", set()),
]


def test_published_licences(spark):
    from tremolo.llm.license_scan import TEMPLATES, scan_licenses

    got = {r.doc_id: r for r in scan_licenses(docs(spark, [t for t, _ in PUBLISHED])).collect()}
    for i, (text, want) in enumerate(PUBLISHED):
        assert set(got[i].labels.split(",")) & set(TEMPLATES) == want, text
        assert (got[i].score == 1.0) == bool(want), text


def test_mix_is_written_by_shards(spark):
    from pyspark.sql import functions as F

    from tremolo.llm.mixing import SHARDS, emit, mix

    d = spark.createDataFrame([(i, f"text {i} " * 5, "abc"[i // 400]) for i in range(1200)], "doc_id long, text string, source string").repartitionByRange(3, "doc_id")  # a source a task
    mixed = mix(d, carry=True)
    want = sorted((r.doc_id, s) for r in mixed.select("doc_id", "shards").collect() for s in r.shards)
    for slices in (1, 3, None):
        rows = emit(mixed, slices=slices, shard_col="shard").withColumn("p", F.spark_partition_id()).collect()
        assert sorted((r.doc_id, r.shard) for r in rows) == want
        parts = {s: sorted({r.p for r in rows if r.shard == s}) for s in range(SHARDS)}
        n = slices or 1  # conftest has four shuffle partitions
        assert all(k * n <= min(p) and max(p) < (k + 1) * n for k, p in parts.items())
        in_order = [r.shard for r in rows]
        assert in_order == sorted(in_order)
        for s in range(SHARDS):
            own = [r.source for r in rows if r.shard == s]
            changes = sum(x != y for x, y in zip(own, own[1:]))
            assert len(set(own)) == 3 and changes > len(own) / 4, (s, changes)
    assert emit(mixed).columns == d.columns
    same = spark.createDataFrame([(None, f"t {i}", "a") for i in range(400)], d.schema)
    assert emit(mix(same, carry=True), slices=4).withColumn("p", F.spark_partition_id()).select("p").distinct().count() >= 4


def test_encodings_are_written(spark):
    import corpus_pipeline as cp
    from tremolo.llm.sampled_pieces import sample_encodings

    d = docs(spark, ["Hello world", "", None, "one two three"])
    got = cp.pieces(spark, d, "")
    want = {(r.doc_id, r.sample): r.ids for r in sample_encodings(d, k=2).collect()}
    assert {(r.doc_id, r.sample): r.ids for r in got.collect()} == want and got.where("size(ids) <> n_pieces or xxhash64(ids) <> ids_hash").count() == 0


def test_every_answer_is_in_a_pair(spark, tmp_path):
    import duckdb

    from tremolo.llm.queries import ORACLE_SQL, QUERIES

    turns = [(0, 0, "user", "q"), (0, 1, "assistant", "a0"), (1, 0, "user", "p"), (1, 1, "assistant", "a1"), (2, 0, "system", "s"), (2, 1, "assistant", "alone"), (4, 0, "user", "no"), (5, 0, "assistant", None), (5, 1, "user", "late"), (8, 0, "user", "x"), (8, 1, "assistant", "")]
    own = tmp_path / "conversations.parquet"
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(own))
    for folder, path in ((str(tmp_path), f"{own}/*.parquet"), ("/root/testdata/sf0.01", "/root/testdata/sf0.01/conversations.parquet")):
        c = duckdb.connect()
        c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}'")
        got = QUERIES["op2_every_answer"](spark, folder)
        rows, names = sorted(tuple(r) for r in got.collect()), ", ".join(got.columns)
        assert rows == sorted(c.sql(f"SELECT {names} FROM ({ORACLE_SQL['op2_every_answer']})").fetchall())
        ids = sorted(x for x, in c.sql("SELECT DISTINCT conv_id FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL").fetchall())
        assert [r[0] for r in rows] == ids
        if folder == str(tmp_path):
            by_id = {r.pair_id: r for r in got.collect()}
            assert ids == [0, 1, 2, 5, 8] and by_id[0].rejected_trained > 0
            assert all((by_id[k].n_prompt, by_id[k].prompt_chars, by_id[k].rejected_chars) == (0, 0, 0) and by_id[k].chosen_trained > 0 for k in (2, 5, 8))
