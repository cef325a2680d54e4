"""Force-directed layout as joins: pair forces, spring forces, integration.

Covers N15-N33, P42, E55-E68. Nodes are (id, ordinal, x, y, z, vx, vy, vz, radius,
pinned, px, py, pz); edges carry an activation alpha. Repulsion acts between all pairs,
which are dealt to pairs of blocks; collisions are found by a grid.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Configuration:
    """Layout parameters (fixed default values)."""

    k: float = 200.0
    initial_temperature: float = 500.0
    cooling: float = 0.99
    damping: float = 0.9
    max_iterations: int = 1000
    convergence: float = 0.1
    dt: float = 0.016
    mass: float = 1.0
    bounds: tuple[float, float, float, float] = (0.0, 0.0, 500.0, 500.0)
    boundary_strength: float = 1000.0
    repulsion: float = 1.0
    attraction: float = 1.0
    gravity: float = 0.5
    collisions: bool = True
    collision_strength: float = 10.0
    flat: bool = True
    z_flattening: float = 100.0
    settle_threshold: float = 0.01
    settle_frames: int = 10


# The presets.
SMALL = Configuration(k=250.0, initial_temperature=600.0, damping=0.85, cooling=0.985, gravity=0.8)
LARGE = Configuration(k=150.0, initial_temperature=400.0, max_iterations=800, cooling=0.995, gravity=1.0)


def repulsive_force(k: float, d: Column, strength: float = 1.0) -> Column:
    """strength k^2 / d^2; 10000 at 0.01 and below."""
    return F.when(d > 0.01, F.lit(strength * k * k) / (d * d)).otherwise(10000.0)


def attractive_force(d: Column, ideal: Column, strength: Column | float = 1.0) -> Column:
    """strength (d - ideal)."""
    return strength * (d - ideal)


def gravity_force(position: Column, strength: float, center: float = 0.0) -> Column:
    """Toward the centre."""
    return (F.lit(center) - position) * strength


def exponential_cooling(temperature: float, factor: float) -> float:
    """N20."""
    return temperature * factor


def linear_cooling(initial: float, iteration: int | Column, most: int) -> float | Column:
    """N21, E68."""
    return (1.0 - iteration / most) * initial


def ramp(alpha: Column, target: Column, speed: Column, dt: float) -> Column:
    """Activation moved toward its target, at most speed x dt."""
    return F.when(alpha < target, F.least(target, alpha + speed * dt)).otherwise(F.greatest(target, alpha - speed * dt))


def ramp_all(edges: DataFrame, to: float, duration: float) -> DataFrame:
    """All edges set on their way to an activation (N24, E61); no change for a duration of 0."""
    return edges if duration <= 0 else edges.withColumn("target", F.lit(float(to))).withColumn("speed", F.abs(F.lit(float(to)) - F.col("alpha")) / duration)


def effective_stiffness(alpha: Column, stiffness: float) -> Column:
    """E63."""
    return alpha * stiffness


AXES = ("x", "y", "z")
#: Nodes of one side of a join of pairs under one key, about.
CROWD = 1000


def _length(*delta: Column) -> Column:
    return F.sqrt(sum((d * d for d in delta[1:]), delta[0] * delta[0]))


def _meet(left: DataFrame, right: DataFrame, cell: list[str], sizes: DataFrame) -> DataFrame:
    """left and right rows of equal cells. A cell of many is cut into parts of about CROWD on both sides, so that no key is crowded."""
    parts = sizes.select(*cell, F.greatest(F.lit(1), F.ceil(F.col("n") / CROWD)).cast("int").alias("parts"))
    part = lambda c: F.pmod(F.xxhash64(c), F.col("parts")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    a = left.join(parts, cell).withColumn("one", part("id")).withColumn("two", every).drop("parts")
    b = right.join(parts, cell).withColumn("two", part("other")).withColumn("one", every).drop("parts")
    return a.join(b, [*cell, "one", "two"]).drop("one", "two")


def _sides(nodes: DataFrame, axes: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    return nodes.select("id", "radius", *axes), nodes.select(F.col("id").alias("other"), F.col("radius").alias("r2"), *[F.col(c).alias(f"{c}2") for c in axes])


def touching(nodes: DataFrame, axes: tuple[str, ...] = AXES) -> DataFrame:
    """Both orders of every two nodes whose discs overlap: id, radius and axes of one, other, r2 and axes with a 2 of the other, and d.

    Nodes lie in the cells of a grid as wide as the largest diameter, so what a node
    touches is in its cell or a neighbouring one (3 to the number of axes).
    """
    a, b = _sides(nodes, axes)
    cell = F.lit(max(2.0 * (nodes.agg(F.max("radius")).first()[0] or 0.0), 1e-9))  # one number
    grid = [f"g{c}" for c in axes]
    at = lambda c: F.floor(F.col(c) / cell)
    b = b.select("*", *[at(f"{c}2").alias(g) for c, g in zip(axes, grid, strict=True)])
    for c, g in zip(axes, grid, strict=True):
        a = a.withColumn(g, F.explode(F.sequence(at(c) - 1, at(c) + 1)))
    met = _meet(a, b, grid, b.groupBy(*grid).agg(F.count("*").alias("n")))
    d = _length(*[F.col(c) - F.col(f"{c}2") for c in axes])
    return met.where("id <> other").withColumn("d", d).where(F.col("radius") + F.col("r2") > F.col("d")).drop(*grid)


def every_pair(nodes: DataFrame, axes: tuple[str, ...] = AXES) -> DataFrame:
    """Both orders of all pairs, with the columns of `touching`, dealt to pairs of blocks of about CROWD nodes."""
    a, b = (side.withColumn("all", F.lit(0)) for side in _sides(nodes, axes))
    met = _meet(a, b, ["all"], b.groupBy("all").agg(F.count("*").alias("n"))).drop("all")
    return met.where("id <> other").withColumn("d", _length(*[F.col(c) - F.col(f"{c}2") for c in axes]))


def collision_forces(nodes: DataFrame, config: Configuration, axes: tuple[str, ...] = AXES) -> DataFrame:
    """id and force components of the overlaps; nodes within 0.01 of each other have no direction and exert none."""
    strength = (F.col("radius") + F.col("r2") - F.col("d")) * config.collision_strength
    return _pushed(touching(nodes, axes), strength, axes)


def _pushed(pairs: DataFrame, strength: Column, axes: tuple[str, ...]) -> DataFrame:
    return pairs.where("d > 0.01").select("id", *[((F.col(c) - F.col(f"{c}2")) / F.col("d") * strength).alias(f"f{c}") for c in axes])


def pair_forces(nodes: DataFrame, config: Configuration, axes: tuple[str, ...] = AXES, collisions: bool | None = None, repulsion: bool = True) -> DataFrame:
    """id and force components of repulsion, over all pairs, and of collisions, over those that overlap."""
    parts = []
    if repulsion:
        parts.append(_pushed(every_pair(nodes, axes), repulsive_force(config.k, F.col("d"), config.repulsion), axes))
    if config.collisions if collisions is None else collisions:
        parts.append(collision_forces(nodes, config, axes))
    none = nodes.limit(0).select("id", *[F.lit(0.0).alias(f"f{c}") for c in axes])
    return none if not parts else parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def spring_forces(nodes: DataFrame, edges: DataFrame, config: Configuration, axes: tuple[str, ...] = AXES) -> DataFrame:
    """id and force components of the edges, on both ends."""
    a = nodes.select(F.col("id").alias("src"), *axes)
    b = nodes.select(F.col("id").alias("dst"), *[F.col(c).alias(f"{c}2") for c in axes])
    alpha = F.col("alpha") if "alpha" in edges.columns else F.lit(1.0)
    delta = {c: F.col(f"{c}2") - F.col(c) for c in axes}
    pulled = edges.withColumn("a", alpha).join(a, "src").join(b, "dst").withColumn("d", _length(*delta.values())).where("d > 0.01")
    pull = attractive_force(F.col("d"), F.col("weight") * config.k, F.lit(config.attraction) * F.col("a"))
    parts = [F.struct(F.col(end).alias("id"), *[(sign * delta[c] / F.col("d") * pull).alias(f"f{c}") for c in axes]) for end, sign in (("src", 1.0), ("dst", -1.0))]
    return pulled.select(F.explode(F.array(*parts)).alias("p")).select("p.*")


def forces(nodes: DataFrame, edges: DataFrame, config: Configuration) -> DataFrame:
    """id, fx, fy, fz."""
    own = nodes.select("id", *[gravity_force(F.col(c), config.gravity).alias(f"f{c}") for c in AXES])
    parts = own.unionByName(pair_forces(nodes, config)).unionByName(spring_forces(nodes, edges, config))
    total = parts.groupBy("id").agg(*[F.sum(f"f{c}").alias(f"f{c}") for c in AXES])
    if config.flat:
        total = total.join(nodes.select("id", "z"), "id").select("id", "fx", "fy", (-F.col("z") * config.z_flattening).alias("fz"))
    return total


def integrate(nodes: DataFrame, force: DataFrame, config: Configuration, temperature: float) -> DataFrame:
    """Nodes one time step on; pinned ones go to their place and rest."""
    factor = min(1.0, temperature / config.initial_temperature)
    both = nodes.join(force, "id")
    out = {}
    for c in AXES:
        v = (F.col(f"v{c}") + F.col(f"f{c}") / config.mass * config.dt) * config.damping
        out[f"v{c}"] = F.when(F.col("pinned"), 0.0).otherwise(v)
        out[c] = F.when(F.col("pinned"), F.col(f"p{c}")).otherwise(F.col(c) + v * factor * config.dt)
    return both.withColumns(out).select(*nodes.columns)


def kinetic_energy(nodes: DataFrame) -> DataFrame:
    """Sum of squared speeds."""
    return nodes.agg(F.coalesce(F.sum(F.col("vx") ** 2 + F.col("vy") ** 2 + F.col("vz") ** 2), F.lit(0.0)).alias("energy"))


def total_energy(force: DataFrame) -> DataFrame:
    """Sum of force sizes and their mean."""
    size = _length(F.col("fx"), F.col("fy"), *([F.col("fz")] if "fz" in force.columns else []))
    return force.agg(F.coalesce(F.sum(size), F.lit(0.0)).alias("total"), F.coalesce(F.avg(size), F.lit(0.0)).alias("average"))


@dataclass(frozen=True)
class Settling:
    """Consecutive quiet frames."""

    threshold: float = 0.01
    required: int = 10
    quiet: int = 0

    def update(self, energy: float) -> Settling:
        return replace(self, quiet=self.quiet + 1 if energy < self.threshold else 0)

    @property
    def settled(self) -> bool:
        return self.quiet >= self.required

    @property
    def progress(self) -> float:
        return self.quiet / self.required


def run(nodes: DataFrame, edges: DataFrame, config: Configuration, steps: int, save) -> tuple[DataFrame, float, Settling]:
    """Nodes, temperature and settling after at most `steps` steps (N25, N29). `save` writes nodes and reads them back, which cuts the lineage."""
    temperature, settling = config.initial_temperature, Settling(config.settle_threshold, config.settle_frames)
    for _ in range(steps):
        nodes = save(integrate(nodes, forces(nodes, edges, config), config, temperature))
        if "alpha" in edges.columns and "target" in edges.columns:
            edges = edges.withColumn("alpha", ramp(F.col("alpha"), F.col("target"), F.col("speed"), config.dt))
        temperature = exponential_cooling(temperature, config.cooling)
        settling = settling.update(kinetic_energy(nodes).first().energy)
        if settling.settled:
            break
    return nodes, temperature, settling


def planar_forces(nodes: DataFrame, edges: DataFrame, config: Configuration, boundary: bool = True) -> DataFrame:
    """id, fx, fy of the two-dimensional variant: gravity to the bounds' centre, and a wall of 50 units."""
    axes = ("x", "y")
    x0, y0, x1, y1 = config.bounds
    center = {"x": (x0 + x1) / 2, "y": (y0 + y1) / 2}
    own = {c: gravity_force(F.col(c), config.gravity, center[c]) for c in axes}
    if boundary:
        for c, low, high in (("x", x0, x1), ("y", y0, y1)):
            wall = lambda d: config.boundary_strength / F.pow(F.greatest(F.lit(0.1), d), F.lit(2))
            own[c] = own[c] + F.when(F.col(c) < low + 50, wall(F.col(c) - low)).otherwise(0.0) - F.when(F.col(c) > high - 50, wall(F.lit(high) - F.col(c))).otherwise(0.0)
    parts = nodes.select("id", *[own[c].alias(f"f{c}") for c in axes]).unionByName(pair_forces(nodes, config, axes)).unionByName(spring_forces(nodes, edges, config, axes))
    return parts.groupBy("id").agg(*[F.sum(f"f{c}").alias(f"f{c}") for c in axes])


def progress(iteration: int, most: int) -> float:
    """E56."""
    return iteration / most


def reheated(temperature: float | Column, config: Configuration, boost: float = 200.0) -> float | Column:
    """E59."""
    if isinstance(temperature, Column):
        return F.least(temperature + boost, F.lit(config.initial_temperature))
    return min(temperature + boost, config.initial_temperature)


def pin(nodes: DataFrame, node, x: float, y: float, z: float = 0.0) -> DataFrame:
    """E60."""
    here = F.col("id") == node
    put = {f"p{c}": F.when(here, float(v)).otherwise(F.col(f"p{c}")) for c, v in zip(AXES, (x, y, z), strict=True)}
    return nodes.withColumns(put | {"pinned": F.col("pinned") | here})


def velocity_noise(nodes: DataFrame, magnitude: float, seed: int, flat: bool = True) -> DataFrame:
    """Uniform noise on the velocities."""
    from popspark.functions.vectors import hashed_unit

    axes = AXES[:2] if flat else AXES
    return nodes.withColumns({f"v{c}": F.col(f"v{c}") + (hashed_unit(seed, c, F.col("id")) * 2 - 1) * magnitude for c in axes})


def world_to_view(x: Column, y: Column, zoom: float, pan: tuple[float, float], canvas: tuple[float, float]) -> Column:
    """N31."""
    return F.struct((x * zoom + pan[0] + canvas[0] / 2).alias("x"), (y * zoom + pan[1] + canvas[1] / 2).alias("y"))


def view_to_world(x: Column, y: Column, zoom: float, pan: tuple[float, float], canvas: tuple[float, float]) -> Column:
    """N32."""
    return F.struct(((x - canvas[0] / 2 - pan[0]) / zoom).alias("x"), ((y - canvas[1] / 2 - pan[1]) / zoom).alias("y"))


def fit_to_view(nodes: DataFrame, canvas: tuple[float, float], margin: float = 0.9) -> DataFrame:
    """zoom (5 at most) and pan that show all nodes; one row."""
    b = nodes.agg(*[f(c).alias(n) for c in ("x", "y") for f, n in ((F.min, f"lo_{c}"), (F.max, f"hi_{c}"))])
    span = {c: F.when(F.col(f"hi_{c}") == F.col(f"lo_{c}"), 200.0).otherwise(F.col(f"hi_{c}") - F.col(f"lo_{c}")) for c in ("x", "y")}
    zoom = F.least(F.lit(canvas[0] * margin) / span["x"], F.lit(canvas[1] * margin) / span["y"], F.lit(5.0))
    out = b.withColumn("zoom", F.coalesce(zoom, F.lit(1.0)))
    pan = lambda c: F.coalesce(-(F.col(f"lo_{c}") + F.col(f"hi_{c}")) / 2 * F.col("zoom"), F.lit(0.0)).alias(f"pan_{c}")
    return out.select("zoom", pan("x"), pan("y"))


def hit(nodes: DataFrame, view: tuple[float, float], zoom: float, pan: tuple[float, float], canvas: tuple[float, float]) -> DataFrame:
    """The first node, by ordinal, whose disc holds the view point; no row if none."""
    at = nodes.withColumn("w", view_to_world(F.lit(view[0]), F.lit(view[1]), zoom, pan, canvas))
    near = _length(F.col("w.x") - F.col("x"), F.col("w.y") - F.col("y"), F.lit(0.0) - F.col("z")) <= F.col("radius")
    return at.where(near).orderBy("ordinal").limit(1).select("id", "ordinal")
