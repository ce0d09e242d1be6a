"""Learning rates as column expressions over a step (epoch or batch number)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of the cyclical modes.
CYCLICAL_MODES = ("linear", "triangular", "triangular2", "exp_range", "one_cycle")


def initial_rates(lr=None, lr_per_sample=None, batch_size=None, warmup_init_lr=0.0) -> tuple:
    """(rate before scaling, rate at the start of warm-up).

    A rate per sample is multiplied by the batch size and also starts the warm-up.
    """
    if (lr is None) == (lr_per_sample is None):
        raise ValueError("give either lr or lr_per_sample")
    if lr_per_sample is not None:
        rate = lr_per_sample * batch_size
        return rate, rate
    return lr, warmup_init_lr


def constant(step: Column, lr: float) -> Column:
    return F.when(step.isNotNull(), F.lit(float(lr)))


def multistep(step: Column, lr: float, milestones, gamma: float = 0.1, warmup: float = 0,
              warmup_start: float = 0.0, scale: float = 1) -> Column:
    """Rate ``lr * scale`` that falls by ``gamma`` at each milestone, after a linear warm-up.

    ``scale`` is the number of workers under the linear scaling rule.
    """
    milestones = [milestones] if isinstance(milestones, (int, float)) else list(milestones)
    if milestones != sorted(milestones):
        raise ValueError(f"milestones must increase: {milestones}")
    if milestones and warmup >= milestones[0]:
        raise ValueError(f"warm-up ({warmup}) must end before the first milestone ({milestones[0]})")
    base = float(lr * scale)
    passed = F.lit(0)
    for milestone in milestones:
        passed = passed + F.when(step >= milestone, 1).otherwise(0)
    rate = F.lit(base) * F.power(F.lit(float(gamma)), passed)
    if not warmup:
        return rate
    rise = (base - float(warmup_start)) * step.cast("double") / float(warmup)
    return F.when(step <= warmup, float(warmup_start) + rise).otherwise(rate)


def cyclical(step: Column, base_lr: float, max_lr: float, length: float, mode: str = "triangular",
             gamma: float = 0.99, extra: float = 0.1, scale_fn=None) -> Column:
    """Triangle wave between two rates with period ``length`` steps.

    ``scale_fn(cycle, step)`` replaces the amplitude rule of the mode.
    """
    if mode not in CYCLICAL_MODES:
        raise ValueError(f"unknown mode {mode}")
    t = step.cast("double")
    # Height of the triangle: 0 at both ends of a period, 1 in its middle.
    height = 1 - F.abs(2 * F.pmod(t, F.lit(float(length))) / float(length) - 1)
    cycle = F.floor(t / float(length)).cast("double") + 1
    if scale_fn is None:
        scale_fn = {"triangular2": lambda c, i: F.lit(1.0) / F.power(F.lit(2.0), c - 1),
                    "exp_range": lambda c, i: F.power(F.lit(float(gamma)), i)}.get(mode, lambda c, i: F.lit(1.0))
    rate = F.lit(float(base_lr)) + (max_lr - base_lr) * height * scale_fn(cycle, t)
    if mode == "one_cycle":
        return F.when(t <= length, rate).otherwise(F.lit(base_lr * extra))
    return rate


# Columns of a table of configurations; those that a schedule does not use may be null.
CONFIGURATION = ("schedule STRING, steps BIGINT, lr DOUBLE, lr_per_sample DOUBLE, batch_size BIGINT, warmup_init_lr DOUBLE, "
                 "workers BIGINT, milestones ARRAY<DOUBLE>, gamma DOUBLE, warmup DOUBLE, mode STRING, max_lr DOUBLE, "
                 "length DOUBLE, extra DOUBLE")


def _checked(good: Column, value: Column, message: str) -> Column:
    """``value``, or an error where ``good`` is false."""
    return F.when(F.coalesce(good, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)).cast("double"))


def configured(step: Column) -> Column:
    """The rate at ``step`` under the configuration in the columns of the same row (``CONFIGURATION``).

    ``const`` holds lr; ``MultiStepLRW`` starts from lr, or lr_per_sample times batch_size, scaled by workers, and ``CLR`` swings
    between lr and max_lr. What is null takes the default of the function for a single schedule. An unknown schedule or
    mode, milestones that do not increase, a warm-up that reaches the first of them and two or no rates are errors.
    """
    at, or_else = step.cast("double"), lambda name, value: F.coalesce(F.col(name), F.lit(value))
    by_sample = F.col("lr_per_sample") * F.col("batch_size")
    given = F.coalesce(by_sample, F.col("lr"))
    base = given * or_else("workers", 1)
    start = F.coalesce(by_sample, or_else("warmup_init_lr", 0.0))
    milestones = F.coalesce("milestones", F.array().cast("array<double>"))
    warmup = or_else("warmup", 0.0)
    falling = base * F.power(or_else("gamma", 0.1), F.size(F.filter(milestones, lambda m: m <= at)))
    stepped = F.when((warmup > 0) & (at <= warmup), start + (base - start) * at / warmup).otherwise(falling)
    orderly = (milestones == F.array_sort(milestones)) & ((F.size(milestones) == 0) | (warmup < F.try_element_at(milestones, F.lit(1))))
    one_rate = F.col("lr").isNull() != F.col("lr_per_sample").isNull()
    stepped = _checked(orderly & one_rate, stepped, "milestones must increase, after the warm-up, and one rate be given")

    mode, length = or_else("mode", "triangular"), F.col("length")
    height = 1 - F.abs(2 * F.pmod(at, length) / length - 1)
    amplitude = F.when(mode == "triangular2", F.power(F.lit(0.5), F.floor(at / length))) \
        .when(mode == "exp_range", F.power(or_else("gamma", 0.99), at)).otherwise(1.0)
    wave = F.when((mode == "one_cycle") & (at > length), F.col("lr") * or_else("extra", 0.1)) \
        .otherwise(F.col("lr") + (F.col("max_lr") - F.col("lr")) * height * amplitude)
    wave = _checked(mode.isin(*CYCLICAL_MODES) & (length > 0) & F.col("lr").isNotNull() & F.col("max_lr").isNotNull(), wave,
                    "a cyclical schedule needs a known mode, a length and two rates")
    name = F.col("schedule")
    return F.when(name == "const", F.col("lr")).when(name == "MultiStepLRW", stepped).when(name == "CLR", wave) \
        .otherwise(F.raise_error(F.concat(F.lit("unknown schedule "), or_else("schedule", "null"))).cast("double"))


SCHEDULES = {"const": constant, "CLR": cyclical, "MultiStepLRW": multistep}


def schedule(name: str, step: Column, **settings) -> Column:
    """A schedule by its registered name."""
    if name not in SCHEDULES:
        raise ValueError(f"unknown schedule {name}")
    return SCHEDULES[name](step, **settings)
