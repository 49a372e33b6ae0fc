"""Semantic advisors: an adapter for any language model, and retries with time limits.

The engine makes no network call of its own: `ask` is the caller's function from a prompt to an answer.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from .discovery import RELEVANCE

#: Values of a column that a prompt shows: all if there are few, else some examples; and what counts as many.
ALL_SHOWN, EXAMPLES, MANY = 10, 5, 50
#: Seconds that a question may take.
LIMITS = {"relevance": 60.0, "utility": 45.0, "verify": 30.0}


class ModelAdvisor:
    """Asks a model about columns; answers are JSON, and what does not fit is left out."""

    def __init__(self, ask: Callable[[str], str]):
        self.ask = ask
        self.values: dict[str, list] = {}
        self.cardinality: dict[str, int] = {}

    def inform(self, values: dict[str, list], cardinality: dict[str, int]) -> None:
        """Example values and numbers of distinct values of the columns."""
        self.values, self.cardinality = values, cardinality

    def _described(self, columns: dict[str, str]) -> str:
        lines = []
        for c, meaning in columns.items():
            known, n = self.values.get(c, []), self.cardinality.get(c)
            shown = known if n is not None and n <= ALL_SHOWN else known[:EXAMPLES]
            about = f"; values: {', '.join(map(str, shown))}" if shown else ""
            many = "; high cardinality" if n is not None and n > MANY else ""
            lines.append(f"- {c}: {meaning}{about}{many}")
        return "\n".join(lines)

    def _answers(self, prompt: str, allowed: tuple[str, ...]) -> dict[str, str]:
        found = json.loads(self.ask(prompt))
        return {c: a for c, a in found.items() if a in allowed} if isinstance(found, dict) else {}

    def relevance(self, rule: str, columns: dict[str, str]) -> dict[str, str]:
        prompt = f"Rule: {rule}\nWhich columns may decide when it holds?\n{self._described(columns)}\nAnswer with a JSON object from column to one of {', '.join(RELEVANCE)}."
        return self._answers(prompt, RELEVANCE)

    def utility(self, columns: dict[str, str]) -> dict[str, str]:
        prompt = f"Which columns are categories, which identify entities?\n{self._described(columns)}\nAnswer with a JSON object from column to categorical or identifier."
        return self._answers(prompt, ("categorical", "identifier"))

    def verify(self, rule: str, condition: str, columns: dict[str, str]) -> bool:
        prompt = f"Rule: {rule}\nCondition: {condition}\n{self._described(columns)}\nDoes the rule make sense under this condition? Answer true or false in JSON."
        return json.loads(self.ask(prompt)) is not False


class Retrying:
    """An advisor whose questions are asked up to `attempts` times, each within its time limit, with growing pauses."""

    def __init__(self, advisor, attempts: int = 3, least: float = 10.0, most: float = 60.0, limits: dict[str, float] | None = None, sleep: Callable[[float], None] = time.sleep):
        self.advisor, self.attempts, self.least, self.most = advisor, attempts, least, most
        self.limits, self.sleep = LIMITS | (limits or {}), sleep

    def inform(self, *about) -> None:
        getattr(self.advisor, "inform", lambda *_: None)(*about)

    def _ask(self, name: str, *args):
        for i in range(self.attempts):
            pool = ThreadPoolExecutor(1)
            try:
                return pool.submit(getattr(self.advisor, name), *args).result(self.limits[name])
            except Exception:
                if i + 1 == self.attempts:
                    raise
                self.sleep(min(self.most, max(self.least, 2.0**i)))
            finally:
                pool.shutdown(wait=False, cancel_futures=True)

    def relevance(self, rule: str, columns: dict[str, str]) -> dict[str, str]:
        return self._ask("relevance", rule, columns)

    def utility(self, columns: dict[str, str]) -> dict[str, str]:
        return self._ask("utility", columns)

    def verify(self, rule: str, condition: str, columns: dict[str, str]) -> bool:
        return self._ask("verify", rule, condition, columns)
