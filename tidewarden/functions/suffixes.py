"""Public suffixes: under which names anyone may register a domain.

The list is the one that ships with Spark (a resource of its HTTP client library),
read once on the driver; only its section of registries counts, not that of private
owners.  ``own`` rules replace it.  As a column the rules are one map literal from a
tail of labels to the labels that make a longer suffix of it, so no list is joined.
"""

from __future__ import annotations

import glob
import os
import zipfile
from functools import lru_cache

import pyspark
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rules where the shipped list is missing.
FEW = "com net org edu gov int mil info biz io co in me ai app dev xyz top site online shop club live link click store tech us uk de fr es eu it nl ru cn jp au ca br ch se no pl pt co.in gov.in nic.in org.in net.in ac.in co.uk org.uk gov.uk ac.uk com.au com.br co.jp".split()
_RESOURCE = "mozilla/public-suffix-list.txt"


@lru_cache
def shipped_rules() -> tuple[str, ...]:
    """Rules of the registries' section; few of our own where there is no list."""
    home = os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__)
    for jar in sorted(glob.glob(os.path.join(home, "jars", "httpclient*.jar"))):
        with zipfile.ZipFile(jar) as archive:
            if _RESOURCE in archive.namelist():
                text = archive.read(_RESOURCE).decode("utf-8").split("===BEGIN PRIVATE DOMAINS===")[0]
                return tuple(line.split()[0] for line in map(str.strip, text.splitlines()) if line and not line.startswith("//"))
    return tuple(FEW)


@lru_cache
def _as_text(rules: tuple[str, ...]) -> str:
    """``tail= label label `` per line; a dot among the labels marks a tail that is itself a top suffix."""
    below: dict[str, set[str]] = {}
    for rule in rules:
        kept, _, parent = rule.removeprefix("!").partition(".")
        if parent:
            below.setdefault(parent, set()).add("!" + kept if rule[0] == "!" else kept)
        else:
            below.setdefault(kept, set()).add(".")
    return "\n".join(f"{k}= {' '.join(sorted(v))} " for k, v in sorted(below.items()))


def suffix_labels(labels: Column, own: tuple[str, ...] | None = None) -> Column:
    """Number of labels of the longest public suffix at the end of ``labels``; 0 if there is none."""
    table = F.str_to_map(F.lit(_as_text(tuple(own) if own is not None else shipped_rules())), F.lit("\n"), F.lit("="))  # folded to one literal
    nth = lambda k: F.get(labels, F.size(labels) - k)
    names = lambda entry, mark, label: F.contains(entry, F.concat(F.lit(" " + mark), label, F.lit(" ")))
    barred = lambda entry, label: names(entry, "!", label)
    longer = lambda entry, label: names(entry, "", label) | (F.contains(entry, F.lit(" * ")) & label.isNotNull())
    one, two = F.try_element_at(table, nth(1)), F.try_element_at(table, F.concat(nth(2), F.lit("."), nth(1)))
    return F.when(barred(two, nth(3)), 2).when(longer(two, nth(3)), 3).when(barred(one, nth(2)), 1).when(longer(one, nth(2)), 2).when(F.contains(one, F.lit(" . ")), 1).otherwise(0)
