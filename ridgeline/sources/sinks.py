"""Sinks: notifiers, of which one that fails does not stop the others, and report files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


class Notifier:
    def send(self, title: str, text: str) -> None:
        raise NotImplementedError


class ConsoleNotifier(Notifier):
    def send(self, title, text):
        print(f"== {title} ==\n{text}")


class FileNotifier(Notifier):
    def __init__(self, path: str):
        self.path = path

    def send(self, title, text):
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(f"== {title} ==\n{text}\n")


class NullNotifier(Notifier):
    def send(self, title, text):
        pass


class MultiNotifier(Notifier):
    def __init__(self, *parts: Notifier):
        self.parts, self.failed = parts, []

    def send(self, title, text):
        for p in self.parts:
            try:
                p.send(title, text)
            except Exception as e:  # the others still get it
                self.failed.append((type(p).__name__, str(e)))


def build_notifier(kind: str, path: str | None = None) -> Notifier:
    made: dict[str, Callable[[], Notifier]] = {"console": ConsoleNotifier, "null": NullNotifier, "file": lambda: FileNotifier(path), "both": lambda: MultiNotifier(ConsoleNotifier(), FileNotifier(path))}
    if kind not in made or (kind in ("file", "both") and not path):
        raise ValueError(f"unknown notifier {kind!r}")
    return made[kind]()


def format_hits(hits: DataFrame, n: int = 20) -> str:
    """The first hits as a text table; a report, so it has a limit."""
    rows = hits.limit(n).collect()
    return "\n".join(f"{r['code']:<12} {r['kind']:<3} {r['level']:<5} {r['ts']:<16} {r['price']:>12.2f} {r['strength']:.3f}" for r in rows)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
