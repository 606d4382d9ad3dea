"""Settings of a run: defaults, command line, environment flags, and checks before anything is read."""

from __future__ import annotations

import argparse
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields, replace

from tessella.functions.text import TRUE
from tessella.operators.augment import Plan

#: name -> whether its width can be scaled and it can be exported to the second format
ARCHITECTURES = {"unet": (True, True), "deeplabv3plus": (False, False), "hrnet": (False, False)}


@dataclass(frozen=True)
class Config:
    data_dir: str | None = None
    val_data_dir: str | None = None
    test_data_dir: str | None = None
    stage1_dir: str | None = None
    stage2_dir: str | None = None
    arch: str = "unet"
    width_mult: float = 1.0
    img_size: int = 512
    batch_size: int = 4
    val_fraction: float = 0.2
    seed: int = 42
    lr: float = 1e-3
    patience: int = 5
    patience_stage1: int = 3
    patience_stage2: int = 5
    multiscale: bool = False
    export_second: bool = False
    device: str = "auto"
    out_dir: str = "output"
    epochs: int = 100
    eval_tiling: bool = False
    crop_min_px: int = 400
    crop_max_px: int = 1024
    aug_hflip_p: float = 0.5
    aug_vflip_p: float = 0.5
    aug_rotate_p: float = 0.0
    aug_rotate_limit: float = 15.0
    aug_bc_p: float = 0.5
    aug_brightness_limit: float = 0.2
    aug_contrast_limit: float = 0.2
    aug_hsv_p: float = 0.5

    def checked(self) -> Config:
        """The same, or a ValueError that says what can't be run."""
        if self.arch not in ARCHITECTURES:
            raise ValueError(f"unknown arch {self.arch!r}: one of {', '.join(ARCHITECTURES)}")
        scalable, exportable = ARCHITECTURES[self.arch]
        if self.width_mult != 1.0 and not scalable:
            raise ValueError(f"width_mult is not for arch {self.arch!r}")
        if self.export_second and not exportable:
            raise ValueError(f"the second export format is not for arch {self.arch!r}")
        if not self.data_dir and not (self.stage1_dir and self.stage2_dir):
            raise ValueError("a data_dir is needed, or a stage1_dir and a stage2_dir")
        if not 0 < self.crop_min_px <= self.crop_max_px:
            raise ValueError("crop_min_px must be above 0 and at most crop_max_px")
        if bad := [f.name for f in fields(self) if f.name.endswith("_p") and not 0 <= getattr(self, f.name) <= 1]:
            raise ValueError(f"not a probability: {', '.join(bad)}")
        return self

    @property
    def augmentation(self) -> Plan:
        """What the training tiles of this run go through; crops only where several scales are asked for."""
        return Plan(
            flip_p=self.aug_hflip_p, vflip_p=self.aug_vflip_p, rotate_p=self.aug_rotate_p, rotate_limit=self.aug_rotate_limit, crop=(self.crop_min_px, self.crop_max_px) if self.multiscale else None,
            brightness_p=self.aug_bc_p, brightness_limit=self.aug_brightness_limit, contrast_limit=self.aug_contrast_limit, hsv_p=self.aug_hsv_p, seed=self.seed,
        )

    def output(self, name: str) -> str:
        """Where this run puts something: checkpoints, logs, model.onnx, test_results.md."""
        return f"{self.out_dir.rstrip('/')}/{name}"

    @property
    def two_stage(self) -> bool:
        return not self.data_dir


def from_args(args: Sequence[str]) -> Config:
    """A flag for each setting; those of booleans have a --no- form."""
    parser = argparse.ArgumentParser()
    for f in fields(Config):
        name = "--" + f.name.replace("_", "-")
        if isinstance(f.default, bool):
            parser.add_argument(name, action=argparse.BooleanOptionalAction, default=f.default)
        else:
            parser.add_argument(name, type=str if f.default is None else type(f.default), default=f.default)
    return Config(**vars(parser.parse_args(args))).checked()


def with_env(config: Config, env: Mapping[str, str], prefix: str = "TESSELLA_") -> Config:
    """Settings from variables such as TESSELLA_BATCH_SIZE."""
    found = {}
    for f in fields(Config):
        if (raw := env.get(prefix + f.name.upper())) is not None:
            found[f.name] = raw.strip().lower() in TRUE if isinstance(f.default, bool) else raw if f.default is None else type(f.default)(raw)
    return replace(config, **found)


def resolve_device(name: str, available: Sequence[str]) -> str:
    """A named device as it is; auto is the first of mps and cuda that there is, else cpu."""
    return name if name != "auto" else next((d for d in ("mps", "cuda") if d in available), "cpu")
