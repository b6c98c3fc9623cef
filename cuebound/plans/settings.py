"""Typed settings of a run in six sections, from YAML."""

from __future__ import annotations

from dataclasses import dataclass
from types import SimpleNamespace
from typing import Any

_REQUIRED = object()
#: Options by section, with what holds where a file does not say; a file must give the others. Each is read from the
#: file's section of the same name, but for the options of _ELSEWHERE.
OPTIONS: dict[str, dict[str, Any]] = {
    "paths": dict.fromkeys(("preprocessed_dataset", "teacher_logits_dir", "checkpoints_dir", "logs_dir", "final_model_dir"), _REQUIRED),
    "model": dict.fromkeys(("student_model_name", "student_pretrained", "freeze_encoder", "teacher_temperature"), _REQUIRED),
    "training": dict.fromkeys(
        (
            "epochs", "batch_size", "gradient_accumulation_steps", "effective_batch_size", "learning_rate", "weight_decay",
            "max_gradient_norm", "warmup_steps", "lr_schedule", "min_learning_rate", "mixed_precision", "save_every_n_steps",
            "eval_every_n_steps", "keep_last_n_checkpoints", "early_stopping_patience", "early_stopping_metric",
        ), _REQUIRED,
    ),
    "distillation": dict.fromkeys(("soft_loss_weight", "hard_loss_weight", "temperature", "enable_mini_batch", "mini_batch_size", "auto_cleanup_logits"), _REQUIRED) | {"ignore_index": -100},
    "data": dict.fromkeys(("sample_rate", "n_mels", "max_audio_length", "max_text_length", "language", "train_split", "random_seed"), _REQUIRED)
    | {"return_timestamps": False, "timestamp_granularity": "word", "n_fft": 400, "hop_length": 160},
    "hardware": dict.fromkeys(("device", "gpu_id", "allow_growth", "num_workers"), _REQUIRED),
}
#: Where a file has options that it does not keep in their own section.
_ELSEWHERE = {
    ("model", "student_model_name"): ("student", "model_name"), ("model", "student_pretrained"): ("student", "pretrained"),
    ("model", "freeze_encoder"): ("student", "freeze_encoder_initially"), ("model", "teacher_temperature"): ("teacher", "temperature"),
    **{("training", name): ("distillation", name) for name in OPTIONS["training"]},
}
_NUMBERS = {"learning_rate", "weight_decay", "max_gradient_norm", "min_learning_rate"}


@dataclass(frozen=True)
class Settings:
    """A section is a namespace of its options: settings.data.sample_rate."""

    project: str
    paths: SimpleNamespace
    model: SimpleNamespace
    training: SimpleNamespace
    distillation: SimpleNamespace
    data: SimpleNamespace
    hardware: SimpleNamespace

    @classmethod
    def of(cls, values: dict[str, dict[str, Any]]) -> Settings:
        """From nested mappings; KeyError names the first option that is missing."""
        sections = {}
        for section, options in OPTIONS.items():
            found = {}
            for name, default in options.items():
                place, key = _ELSEWHERE.get((section, name), (section, name))
                value = (values.get(place) or {}).get(key, default)
                if value is _REQUIRED:
                    raise KeyError(f"{place}.{key}")
                found[name] = float(value) if name in _NUMBERS else value
            sections[section] = SimpleNamespace(**found)
        if "name" not in (values.get("project") or {}):
            raise KeyError("project.name")
        return cls(values["project"]["name"], **sections)

    @classmethod
    def read(cls, path: str) -> Settings:
        """From a YAML file."""
        with open(path, encoding="utf-8") as file:
            return cls.of(parse_yaml(file.read()))


def parse_yaml(text: str) -> dict[str, Any]:
    """Nested mappings of scalars. With a YAML library the whole language, without one what such files use: keys by indentation,
    comments, quoted and plain scalars; ValueError for anything else."""
    try:
        import yaml
    except ImportError:
        return _mappings(text)
    return yaml.safe_load(text) or {}


def _mappings(text: str) -> dict[str, Any]:
    root: dict[str, Any] = {}
    open_at: list[tuple[int, dict[str, Any]]] = [(-1, root)]
    for number, line in enumerate(text.splitlines(), 1):
        body = line.strip()
        if not body or body.startswith("#") or body == "---":
            continue
        depth = len(line) - len(line.lstrip(" "))
        key, colon, value = body.partition(":")
        if not colon or body.startswith(("- ", "[", "{")) or value[:1] not in ("", " "):
            raise ValueError(f"line {number}: not a mapping")
        while open_at[-1][0] >= depth:
            open_at.pop()
        value = value.strip()
        if not value or value.startswith("#"):
            open_at[-1][1][key] = child = {}
            open_at.append((depth, child))
        else:
            open_at[-1][1][key] = _scalar(value)
    return root


def _scalar(value: str) -> Any:
    if value[0] in "\"'":
        return value[1 : value.index(value[0], 1)]
    value = value.split(" #")[0].strip()
    named = {"true": True, "false": False, "null": None, "~": None}
    if value.lower() in named:
        return named[value.lower()]
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            continue
    return value
