"""Column functions."""

from vecloom.functions.arrays import (
    clamp,
    concat_mask,
    layer_norm,
    layout,
    let,
    linear_project,
    quantize_f16,
    scale_latents,
    scale_pixels,
    squeeze,
)
from vecloom.functions.arrow import once
from vecloom.functions.draws import hash_word, sample_noise, sample_time
from vecloom.functions.flow import (
    interpolate,
    lr_schedule,
    recover_latent,
    target_velocity,
    time_embedding,
    velocity_mse,
)
from vecloom.functions.text import hash_embed, tokenize_pad

__all__ = [
    "clamp",
    "concat_mask",
    "hash_embed",
    "hash_word",
    "interpolate",
    "layer_norm",
    "layout",
    "let",
    "linear_project",
    "lr_schedule",
    "once",
    "quantize_f16",
    "recover_latent",
    "sample_noise",
    "sample_time",
    "scale_latents",
    "scale_pixels",
    "squeeze",
    "target_velocity",
    "time_embedding",
    "tokenize_pad",
    "velocity_mse",
]
