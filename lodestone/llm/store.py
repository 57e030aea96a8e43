"""What every corpus operator needs: stored tables and the words of a text."""

from lodestone.store import Scope, Stored, fresh, shared_dir, table, tasks

__all__ = ["BLANKS", "GAP", "WORD", "Scope", "Stored", "fresh", "shared_dir", "table", "tasks"]

#: The words of a text: maximal runs of characters other than blank, tab, LF, VT, FF and CR. Python's bytes.split()
#: with no argument splits at exactly these six bytes.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
