"""Timing and messages."""

from __future__ import annotations

import functools
import time


def spelled(seconds: float) -> str:
    """Seconds as text: in seconds below a minute, then minutes, then hours."""
    if seconds < 60:
        return f"{seconds:.4f} seconds"
    minutes, rest = divmod(seconds, 60)
    if minutes < 60:
        return f"{int(minutes)} minutes {rest:.0f} seconds"
    hours, minutes = divmod(int(minutes), 60)
    return f"{hours} hours {minutes} minutes {rest:.0f} seconds"


def timer(func):
    """Prints how long each call takes."""

    @functools.wraps(func)
    def run(*args, **kwargs):
        start = time.perf_counter()
        out = func(*args, **kwargs)
        print(f"{func.__name__}: {spelled(time.perf_counter() - start)}")
        return out

    return run


class Printer:
    """Messages at levels: 0 says nothing, a message shows at its own level or above it; errors always show."""

    MARKS = ("", " * ", "   - ", "     . ", "       ", "         ")

    def __init__(self, verbose: bool | int = True):
        self.level = 5 if verbose is True else int(verbose)

    def print(self, message: str, order: int | str = 1, breakline: str | None = None, force_print: bool = False) -> None:
        if order == "error":
            print(f"error: {message}")
        elif order not in range(1, 6):
            raise ValueError("order is 1 to 5, or error")
        elif self.level >= order or force_print:
            if breakline:
                print(breakline * 75)
            print(f"{self.MARKS[order]}{message}")
