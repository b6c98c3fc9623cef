"""Decoding of token sequences: filters of logits, greedy and beam search, ranking. The model is any function from sequences to
logits, so these are plain numpy; greedy steps over stored logits are array functions (functions.arrays)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Model = Callable[[list[list[int]]], np.ndarray]


def log_softmax(logits: np.ndarray) -> np.ndarray:
    """Log probabilities along the last axis."""
    top = logits.max(axis=-1, keepdims=True)
    return logits - top - np.log(np.exp(logits - top).sum(axis=-1, keepdims=True))


#: What was said last, as far as times go: nothing, text, a time after text, or a time after which text must follow.
NOTHING, TEXT, OPENED, CLOSED = range(4)
#: The state after a text token and after a time, by the state before.
_AFTER = {NOTHING: (TEXT, CLOSED), TEXT: (TEXT, OPENED), OPENED: (TEXT, CLOSED), CLOSED: (TEXT, CLOSED)}


@dataclass(frozen=True)
class Rules:
    """What a sequence may contain: suppressed ids; ids that must not come first; where time tokens begin (none: no time rules),
    the end token, the mark for no times, and the latest first time."""

    begin: int
    end: int
    suppress: Sequence[int] = ()
    not_first: Sequence[int] = ()
    times: int | None = None
    no_times: int | None = None
    latest_first: int | None = None

    def allowed(self, size: int, tokens: list[int]) -> np.ndarray:
        """Which of size ids may follow tokens. A sequence begins with a time, no later than latest_first; a time that closes a text is
        followed by the end or by a time; two times by text; times never go back, and a new text begins later than the last."""
        may = np.ones(size, bool)
        may[list(self.suppress)] = False
        said = tokens[self.begin :]
        if not said:
            may[list(self.not_first)] = False
        if self.times is None:
            return may
        if self.no_times is not None:
            may[self.no_times] = False
        state, last = NOTHING, None
        for token in said:
            is_time = token >= self.times
            state, last = _AFTER[state][is_time], token if is_time else last
        if state == NOTHING:
            may[: self.times] = False
            if self.latest_first is not None:
                may[self.times + self.latest_first + 1 :] = False
        elif state == OPENED:
            may[: self.end] = False
        elif state == CLOSED:
            may[self.times :] = False
        if last is not None:
            may[self.times : last + (state != OPENED)] = False
        return may

    def apply(self, logits: np.ndarray, tokens: list[int]) -> np.ndarray:
        """logits with minus infinity where the rules exclude a token after tokens; text too where all times together are likelier than
        any other token."""
        out = np.where(self.allowed(len(logits), tokens), logits.astype(np.float64), -np.inf)
        if self.times is not None and np.isfinite(out[self.times :]).any():
            all_times = np.logaddexp.reduce(out[self.times :])  # the normalizer is the same on both sides
            if all_times > out[: self.times].max(initial=-np.inf):
                out[: self.times] = -np.inf
        return out


@dataclass(order=True)
class Hypothesis:
    """A sequence with the sum of its log probabilities."""

    score: float
    tokens: list[int] = field(compare=False)

    def ranked(self, begin: int, alpha: float | None) -> float:
        """The score over the length penalty."""
        length = max(1, len(self.tokens) - begin)
        return self.score / (length if alpha is None else ((5 + length) / 6) ** alpha)


def greedy(model: Model, start: list[int], rules: Rules, limit: int) -> Hypothesis:
    """The likeliest token at each step until the end token or limit tokens; all log probabilities count."""
    found = Hypothesis(0.0, list(start))
    for _ in range(limit):
        chance = log_softmax(rules.apply(model([found.tokens])[0], found.tokens))
        best = int(chance.argmax())
        found = Hypothesis(found.score + float(chance[best]), [*found.tokens, best])
        if best == rules.end:
            break
    return found


def beam(model: Model, start: list[int], rules: Rules, limit: int, width: int, patience: float = 1.0) -> list[Hypothesis]:
    """Finished sequences of a beam search, best first: each step keeps the width likeliest that go on, until patience * width are
    finished or limit is reached; then the best unfinished ones fill up what is missing."""
    live, done, enough = [Hypothesis(0.0, list(start))], [], round(width * patience)
    for _ in range(limit):
        logits, options = model([s.tokens for s in live]), []
        for s, row in zip(live, logits, strict=True):
            chance = log_softmax(rules.apply(row, s.tokens))
            for t in np.argsort(-chance, kind="stable")[: width + 1]:
                if np.isfinite(chance[t]):
                    options.append(Hypothesis(s.score + float(chance[t]), [*s.tokens, int(t)]))
        options.sort(key=lambda s: (-s.score, s.tokens))
        live = []
        for s in options:
            if s.tokens[-1] == rules.end:
                done.append(s)
            else:
                live.append(s)
            if len(live) == width:
                break
        if len(done) >= enough or not live:
            break
    rest = sorted(live, reverse=True)[: max(0, width - len(done))]
    return sorted([*done, *(Hypothesis(s.score, [*s.tokens, rules.end]) for s in rest)], reverse=True)


def check_options(temperature: float = 0.0, width: int | None = None, best_of: int | None = None, patience: float | None = None, alpha: float | None = None) -> None:
    """ValueError for options that do not go together: a search of a width samples nothing, so it has no best of several samples, nor has
    temperature 0; patience is a search's; the length penalty's exponent lies between 0 and 1."""
    if best_of is not None and (width is not None or temperature == 0):
        raise ValueError("best_of needs sampling: no width, and a temperature above 0")
    if patience is not None and width is None:
        raise ValueError("patience needs a width")
    if alpha is not None and not 0 <= alpha <= 1:
        raise ValueError("alpha must be between 0 and 1")


def start_tokens(sot: list[int], prompt: list[int] | None = None, prefix: list[int] | None = None, context: int = 448, previous: int = 50361, sample: int = 224) -> list[int]:
    """The ids to start with: the end of a prompt after its mark, the start sequence, a prefix that leaves room for the sample."""
    ids = list(sot)
    if prefix:
        ids += prefix[-max(0, context // 2 - sample) :] if context // 2 > sample else list(prefix)
    if prompt:
        ids = [previous, *prompt[-(context // 2 - 1) :], *ids]
    return ids


def decode_rows(df: DataFrame, key: str, starts: str, model: Model, rules: Rules, limit: int, width: int, alpha: float | None = None) -> DataFrame:
    """(key, tokens, score) of the best sequence of a beam search from each row's start ids, by the length penalty."""

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            best = [max(beam(model, list(s), rules, limit, width), key=lambda x: x.ranked(rules.begin, alpha)) for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b.tokens for b in best], pa.list_(pa.int32())), pa.array([b.score for b in best], pa.float64())], names=[key, "tokens", "score"])

    return df.select(key, starts).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, tokens array<int>, score double")
