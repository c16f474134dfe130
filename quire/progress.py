"""What a command shows of its progress on a terminal."""

from __future__ import annotations

import os
from typing import TextIO

# Colours by their terminal codes.
CYAN, GREEN, YELLOW, DIM, RESET = "\033[36m", "\033[32m", "\033[33m", "\033[2m", "\033[0m"
CELLS = 20


def is_terminal(f: TextIO) -> bool:
    return bool(getattr(f, "isatty", lambda: False)())


def colored(code: str, text: str, f: TextIO) -> str:
    """text in colour, unless f is no terminal or NO_COLOR is set."""
    return f"{code}{text}{RESET}" if is_terminal(f) and not os.environ.get("NO_COLOR") else text


def duration(seconds: float) -> str:
    whole = int(seconds + 0.5)
    return f"{whole // 60}m{whole % 60}s" if whole >= 60 else f"{whole}s"


def bar(done: int, total: int, elapsed: float, status: str, f: TextIO) -> str:
    """One line: a bar, the share, pages, seconds a page, the time so far and the time left at this pace."""
    if total <= 0:
        return ""
    share = min(1.0, done / total)
    filled = int(share * CELLS)
    pace, left = (f"{elapsed / done:.1f}s/page", duration(elapsed / done * (total - done))) if done else ("--s/page", "--s")
    mark = colored(GREEN, "\u2714", f) if done == total else colored(CYAN, "\u23f3", f)
    drawn = colored(CYAN, "\u2588" * filled + "\u2591" * (CELLS - filled), f)
    tail = " | " + colored(DIM, status, f) if status else ""
    return f"\r\033[K  {mark} [{drawn}] {int(share * 100):3d}% | {done}/{total} pages | {pace} | Elapsed: {duration(elapsed)} | ETA: {left}{tail}"
