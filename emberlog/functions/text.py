"""Pattern text for the message filter."""

from __future__ import annotations


def contains_pattern(q: str, literal: bool = False) -> str:
    """Case-insensitive LIKE pattern for "message contains q".

    By default % and _ in q stay wildcards and a backslash takes the next
    character literally, the closing % included. A backslash in front of an
    ordinary character is dropped, since Spark refuses that form. With literal
    set, every character of q stands for itself.
    """
    if literal:
        return "%" + "".join("\\" + c if c in "%_\\" else c for c in q) + "%"
    pattern, out, i = f"%{q}%", [], 0
    while i < len(pattern):
        if pattern[i] == "\\":
            i += 1
            if pattern[i] in "%_\\":
                out.append("\\")
        out.append(pattern[i])
        i += 1
    return "".join(out)


def literal_parts(pattern: str) -> list[str]:
    """The texts between the wildcards of a LIKE pattern; each stands in every match as it is."""
    parts, i = [""], 0
    while i < len(pattern):
        if pattern[i] in "%_":
            parts.append("")
        else:
            i += pattern[i] == "\\"
            parts[-1] += pattern[i]
        i += 1
    return [part for part in parts if part]
