"""Structure texts brought to one spelling: what is left are the atoms of the main component in their order."""

from __future__ import annotations

import re

from molquarry.functions.text import INVISIBLE

_BLANK = re.compile("[" + INVISIBLE.replace("\\p{Cc}", "\\x00-\\x1f\\x7f-\\x9f") + "]+")
#: A bar-delimited extension, or a name after a tab, follows the structure. A tail that could be structure is none.
_EXTENSION = re.compile(r"\s+\|[^|]*\|\s*$")
_NAME = re.compile(r"\t[^\t]*?(?:[ad-hjkmqt-z]|(?<!\[)[lip])[^\t]*$")
_STEREO = re.compile(r"[@/\\]+")
_PLAIN_ATOM = re.compile(r"\[(Cl|Br|[BCNOPSFI])H?[0-9]*\]")
_RING = re.compile(r"\[[^\[\]]*\]|%\([0-9]+\)|%[0-9][0-9]|[0-9]")


def _renumbered(text: str) -> str:
    """Ring numbers in the order in which they open, each the lowest that is free."""
    given: dict[str, int] = {}
    free: list[int] = []
    top = 0

    def put(m: re.Match) -> str:
        nonlocal top
        token = m.group()
        if token[0] == "[":
            return token
        name = token.strip("%()").lstrip("0") or "0"
        n = given.pop(name, None)
        if n is None:
            if free:
                n = min(free)
                free.remove(n)
            else:
                top += 1
                n = top
            given[name] = n
        else:
            free.append(n)
        return str(n) if n < 10 else f"%{n}"

    return _RING.sub(put, text)


def molecule_text(smiles: str | None) -> str:
    """The largest component without remarks, blanks, stereo marks and special ring numbers; '' if there is nothing.

    Of components of one length the first in order counts.
    """
    if not smiles:
        return ""
    text = smiles if "\t" not in smiles and "|" not in smiles else _NAME.sub("", _EXTENSION.sub("", smiles.strip()))
    text = _STEREO.sub("", _BLANK.sub("", text))
    if "." in text:
        text = max(sorted(text.split(".")), key=len)
    return _renumbered(_PLAIN_ATOM.sub(r"\1", text))
