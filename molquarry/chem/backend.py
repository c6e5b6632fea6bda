"""What operators need to know of molecules, behind one interface.

The text backend works everywhere, inside the JVM, from the text alone: its fingerprints are hashed character grams,
its scaffolds ring-bearing cores by pattern. The toolkit backend is there only where its library can be imported.
"""

from __future__ import annotations

import importlib.util
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molquarry.functions import smiles as S
from molquarry.functions.text import let, without_blanks

#: Presence patterns of functional groups in texts (fixed values): names and what to look for.
GROUP_PATTERNS = {
    "amide": "C\\(=O\\)N|NC\\(=O\\)", "ester": "C\\(=O\\)O[Cc]", "acid": "C\\(=O\\)O(?![A-Za-z])", "nitrile": "C#N|N#C", "alkyne": "C#C", "sulfonyl": "S\\(=O\\)\\(=O\\)",
    "ether": "[Cc]O[Cc]", "fluoro": "F", "chloro": "Cl", "bromo": "Br", "thioether": "CSC", "aromatic": "c", "phosphorus": "P", "hydroxyl": "\\(O\\)|O$|^O(?![=C])", "amine": "N\\(C\\)|NC", "urea": "NC\\(=O\\)N",
}
#: Numeric descriptors of the text backend, in order.
DESCRIPTORS = ("heavy_atoms", "carbons", "nitrogens", "oxygens", "sulfurs", "halogens", "aromatic_atoms", "rings", "branches", "double_bonds", "triple_bonds", "stereo_marks", "charges", "components", "length")


class Backend(Protocol):
    def valid(self, c: Column) -> Column: ...
    def canonical(self, c: Column) -> Column: ...
    def standard(self, c: Column) -> Column: ...
    def fingerprint(self, c: Column, bits: int = 2048, radius: int = 4) -> Column: ...
    def groups(self, c: Column) -> Column: ...
    def descriptors(self, c: Column) -> Column: ...
    def scaffold(self, c: Column, generic: bool = False) -> Column: ...


class TextBackend:
    """All as expressions over the text; null and blank texts give null."""

    def _text(self, c: Column) -> Column:
        return F.nullif(without_blanks(c), F.lit(""))

    def valid(self, c: Column) -> Column:
        t = self._text(c)
        return t.isNotNull() & S.fault(t).isNull()

    def reason(self, c: Column) -> Column:
        """Why a text isn't valid, as data; null if it is."""
        t = self._text(c)
        return F.when(t.isNull(), "empty").otherwise(S.fault(t))

    def canonical(self, c: Column) -> Column:
        """Components in order; null unless valid."""
        return F.when(self.valid(c), F.array_join(F.array_sort(F.split(self._text(c), "\\.")), "."))

    def standard(self, c: Column) -> Column:
        """The largest component without stereo marks and charges; null unless valid."""
        parts = F.split(self._text(c), "\\.")
        largest = F.array_max(F.transform(parts, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
        bare = F.regexp_replace(F.regexp_replace(largest, "[@/\\\\]", ""), "[+-][0-9]*\\]", "]")
        return F.when(self.valid(c), F.regexp_replace(bare, "\\[([BCNOPSF]|Cl|Br|I)H?[0-9]*\\]", "$1"))

    def fingerprint(self, c: Column, bits: int = 2048, radius: int = 4) -> Column:
        """Sorted numbers of the bits that the text's grams of 1 to radius characters set."""
        t = self._text(c)

        def hashed(x: Column) -> Column:
            grams = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - n + 1, F.lit(1))), lambda i: F.substring(x, i, F.lit(n)))
            every = F.flatten(F.array(*(grams(n) for n in range(1, radius + 1))))
            return F.array_sort(F.array_distinct(F.transform(every, lambda g: F.pmod(F.xxhash64(g), F.lit(bits)).cast("int"))))

        return F.when(t.isNotNull(), let(t, hashed))

    def groups(self, c: Column) -> Column:
        """A 0/1 array of the patterns present."""
        return F.when(self._text(c).isNotNull(), F.array(*(self._text(c).rlike(p).cast("int") for p in GROUP_PATTERNS.values())))

    def descriptors(self, c: Column) -> Column:
        """A struct of DESCRIPTORS."""
        t = self._text(c)
        n = lambda p: F.regexp_count(t, F.lit(p)).cast("double")
        values = [
            S.atom_count(t).cast("double"), n("C(?!l)|c"), n("N|n"), n("O|o"), n("S|s"), n("F|Cl|Br|I"), n("[bcnops]"), n("[0-9]") / 2, n("\\("), n("="), n("#"), n("@+|/|\\\\"), n("[+-][0-9]*\\]"),
            n("\\.") + 1, F.length(t).cast("double"),
        ]
        return F.when(t.isNotNull(), F.struct(*(v.alias(k) for k, v in zip(DESCRIPTORS, values))))

    def scaffold(self, c: Column, generic: bool = False) -> Column:
        """From the first ring atom to the last ring mark; generic turns all atoms to C and bonds to single. The text itself without rings."""
        t = self.standard(c)
        core = F.regexp_extract(t, "^[^0-9]*?([A-Za-z\\[][^0-9\\[\\]]{0,3}\\]?[0-9].*[0-9])", 1)
        own = F.when(core == "", t).otherwise(core)
        if generic:
            own = F.regexp_replace(F.regexp_replace(F.regexp_replace(own, "\\[[^\\]]*\\]", "C"), "Cl|Br|[A-Za-z]", "C"), "[=#]", "")
        return F.coalesce(own, c)

    def key(self, c: Column) -> Column:
        """A structure key: the hash of the standard text; null unless valid."""
        return F.upper(F.substring(F.sha2(self.standard(c), 256), 1, 27))

    def fallback_rate(self, df: DataFrame, col: str) -> DataFrame:
        """n_distinct, n_fallback: distinct values, and those without a ring, whose scaffold is themselves."""
        one = df.select(F.col(col).alias("v")).filter("v is not null").distinct()
        return one.agg(F.count("*").alias("n_distinct"), F.count_if(~F.coalesce(self.standard(F.col("v")).rlike("[0-9]"), F.lit(False))).alias("n_fallback"))


def capped(c: Column, caps: dict[str, str]) -> Column:
    """Attachment points replaced by the cap of their number: {'1': 'C', '2': 'N'}; others become hydrogens."""
    for number, cap in caps.items():
        c = F.replace(c, F.lit(f"[*:{number}]"), F.lit(cap))
    return F.regexp_replace(c, "\\[\\*(:[0-9]+)?\\]", "[H]")


def capped_variants(df: DataFrame, component: str, caps: dict[str, list[str]]) -> DataFrame:
    """Each distinct component with every cap form: component, cap_type, cap, smiles, error (null if valid)."""
    from molquarry.operators.relational import variants

    own = variants(df.select(component).filter(F.col(component).isNotNull()).distinct(), caps)
    text = F.regexp_replace(F.col(component), "\\[\\*(:[0-9]+)?\\]|\\*", "\u0001")
    smiles = F.replace(text, F.lit("\u0001"), F.col("cap"))
    return own.withColumn("smiles", smiles).withColumn("error", TextBackend().reason(F.col("smiles")))


def attachment_environment(c: Column, number: int, hops: int = 4) -> Column:
    """Up to `hops` characters of bonds and atoms on both sides of an attachment point; null if it isn't there exactly once."""
    mark = f"\\[\\*:{number}\\]"
    around = F.regexp_extract(c, f"(.{{0,{hops}}}){mark}(.{{0,{hops}}})", 0)
    return F.when(F.regexp_count(c, F.lit(mark)) == 1, around)


def attachment_table(df: DataFrame, key: str, linker: str, hops: int = 4) -> DataFrame:
    """Two rows a linker: key, attachment, environment, error."""
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("attachment"), attachment_environment(F.col(linker), n, hops).alias("environment")) for n in (1, 2)))).alias("_r")
    got = df.select(key, linker, rows).select(key, F.col("_r.attachment").alias("attachment"), F.col("_r.environment").alias("environment"), F.col(linker).alias("_l"))
    return got.withColumn("error", F.when(F.col("_l").isNull(), "no linker").when(F.col("environment").isNull(), "no single attachment point")).drop("_l")


def classified(c: Column, patterns: dict[str, str], other: str = "others") -> Column:
    """The name of the first pattern that the text has."""
    out = F.lit(other)
    for name, p in reversed(patterns.items()):
        out = F.when(c.rlike(p), name).otherwise(out)
    return out


def evidence(c: Column, known: dict[str, str]) -> Column:
    """Names of known fragments that the text contains, joined by ';', 'none' if there are none."""
    found = F.array_compact(F.array(*(F.when(c.contains(text), name) for name, text in known.items())))
    return F.when(F.size(found) > 0, F.array_join(found, ";")).otherwise("none")


def backend(name: str = "text") -> Backend:
    """The backend of a name; an error tells if its library isn't there."""
    if name == "text":
        return TextBackend()
    if importlib.util.find_spec(name) is None:
        raise ImportError(f"backend {name} needs its library, which isn't installed; use 'text'")
    raise NotImplementedError(f"no adapter for {name} is registered")
