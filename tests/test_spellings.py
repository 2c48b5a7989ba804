"""Lenient spellings against Python's own regular expressions, all pairs."""

import re

from rostrum.functions import names
from rostrum.operators import enrich


def test_all_pairs(spark):
    known = ["Türkân Turgut Arıkan", "İsmail Şengün", "Ayşe (Ank.)", "isim", "ıtır", "Ali", "", None, "a.b", "Çağ"]
    found = ["Turkan Turgut Arikan", "TÜRKÂN", "Turkân Turgut Artkan", "Ismail Sengun", "tsmail Şengun", "Ayse (Ank.)", "Ayse (Ankx)", "isım", "tsîm", "isim\n", "itir", "tttr", "Ali", "ali", "Alı", "axb", "a.b", "cag", "CaĞ", "", None]
    rows = lambda xs, c: spark.createDataFrame([(x, i) for i, x in enumerate(xs)], f"{c} string, n int")
    got = enrich.lenient_names(rows(known, "k"), rows(found, "f").drop("n"), "k", "f").select("k", "f").collect()
    pattern = lambda k: "".join(f"[{names.SPELLINGS[c]}]" if c in names.SPELLINGS else re.escape(c) for c in k)
    want = {(k, f) for k in known for f in found if k and f and re.fullmatch(pattern(k), f)}
    assert sorted(map(tuple, got)) == sorted(want) and len(want) >= 11
