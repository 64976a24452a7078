"""Quantum chemistry outputs into tables: logs, structured JSON, XYZ geometries, density cubes and bond orders.

Every reader takes rows of whole files and gives long tables keyed by mol_id, the file's stem. A block that a file lacks gives no rows
in its table and a false flag in summary(); no file is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions.elements import symbol_of
from gneiss.sources.text_blocks import block, every, numbers, rows_of

HARTREE_EV = 27.2114
BOHR = 0.529177249


def read_files(spark: SparkSession, path: str, suffix: str = "*", least: int | None = None, most: int | None = None) -> DataFrame:
    """(mol_id, text) of the files of a folder, by suffix and size in bytes; sizes are filtered before contents are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path)
    if least is not None:
        files = files.where(F.col("length") >= least)
    if most is not None:
        files = files.where(F.col("length") <= most)
    return files.select(stem(F.col("path")).alias("mol_id"), F.decode("content", "UTF-8").alias("text"))


def stem(path):
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


# --- logs -------------------------------------------------------------------------------------------------------------


def _atom_lines() -> Column:
    row = r"(?m)^\s*\d+\s+\d+\s+\d+\s+[-\d.]+\s+[-\d.]+\s+[-\d.]+\s*$"
    return F.regexp_extract_all(F.coalesce(block(F.col("text"), "Standard orientation:", "Rotational constants"), F.lit("")), F.lit(row), F.lit(0))


def _atom(cells: Column) -> list[Column]:
    """symbol, x, y and z of the cells of a line."""
    return [symbol_of(F.get(cells, F.lit(1)).cast("int")).alias("symbol"), *[F.get(cells, F.lit(3 + i)).cast("double").alias(n) for i, n in enumerate("xyz")]]


def _cells(line: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")


def log_atoms(logs: DataFrame) -> DataFrame:
    """(mol_id, atom_idx, symbol, x, y, z) of the last standard orientation."""
    cells = logs.select("mol_id", F.posexplode(_atom_lines()).alias("k", "line")).select("mol_id", "k", _cells(F.col("line")).alias("c"))
    return cells.select("mol_id", (F.col("k") + 1).alias("atom_idx"), *_atom(F.col("c")))


def _npa_charges() -> Column:
    return every(numbers(block(F.col("text"), "Summary of Natural Population Analysis", "====")), 5, 0)


def log_npa_charges(logs: DataFrame) -> DataFrame:
    """(mol_id, atom_idx, charge) of the last natural population summary: the first of each atom's five numbers."""
    return logs.select("mol_id", F.posexplode_outer(_npa_charges()).alias("k", "charge")).where("k IS NOT NULL").select("mol_id", (F.col("k") + 1).alias("atom_idx"), "charge")


def _hirshfeld() -> Column:
    return rows_of(numbers(block(F.col("text"), "Hirshfeld charges, spin densities, dipoles, and CM5 charges", "Tot ")), 6)


def log_hirshfeld(logs: DataFrame) -> DataFrame:
    """(mol_id, atom_idx, hirshfeld, cm5) of the last such block: the first and the sixth of each atom's six numbers."""
    each = logs.select("mol_id", F.posexplode_outer(_hirshfeld()).alias("k", "r")).where("k IS NOT NULL")  # an inner one computes the rows again, to filter
    return each.select("mol_id", (F.col("k") + 1).alias("atom_idx"), F.get("r", F.lit(0)).alias("hirshfeld"), F.get("r", F.lit(5)).alias("cm5"))


def _dipole() -> Column:
    return numbers(block(F.col("text"), "Dipole moment", "Quadrupole moment"))


def log_dipole(logs: DataFrame) -> DataFrame:
    """(mol_id, dx, dy, dz, total) of the last dipole block."""
    return logs.select("mol_id", _dipole().alias("v")).where("size(v) >= 4").select("mol_id", *[F.get("v", F.lit(i)).alias(n) for i, n in enumerate(("dx", "dy", "dz", "total"))])


def _polarizability() -> list[Column]:
    get = lambda word: F.translate(F.regexp_extract("text", rf"(?m)^\s*{word}\s+([-+]?\d+\.\d+(?:[DE][-+]?\d+)?)", 1), "D", "E").try_cast("double") * 1000
    return [get("iso").alias("iso"), get("aniso").alias("aniso")]


def log_polarizability(logs: DataFrame) -> DataFrame:
    """(mol_id, iso, aniso), null where missing, in a thousandth of the printed unit."""
    return logs.select("mol_id", *_polarizability())


def log_modes(logs: DataFrame) -> DataFrame:
    """(mol_id, mode_idx, frequency, ir)."""
    body = block(F.col("text"), "Harmonic frequencies", "Thermochemistry")
    line = lambda word: F.flatten(F.transform(F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(rf"{word}[^\n]*"), F.lit(0)), numbers))
    both = logs.select("mol_id", F.posexplode(F.arrays_zip(line("Frequencies --").alias("f"), line(r"IR Inten\s+--").alias("i"))).alias("k", "m"))
    return both.select("mol_id", (F.col("k") + 1).alias("mode_idx"), F.col("m.f").alias("frequency"), F.col("m.i").alias("ir"))


def log_displacements(logs: DataFrame) -> DataFrame:
    """(mol_id, mode_idx, atom_idx, x, y, z): each frequency block has lines of atom, element and three vectors, fewer in the last."""
    body = block(F.col("text"), "Harmonic frequencies", "Thermochemistry")
    blocks = logs.select("mol_id", F.posexplode(F.split(body, "Frequencies --", -1)).alias("b", "part")).where("b > 0")
    lines = F.regexp_extract_all("part", F.lit(r"(?m)^\s+\d+\s+\d+(?:\s+[-+]?\d+\.\d+){3,9}\s*$"), F.lit(0))
    atoms = blocks.select("mol_id", "b", F.explode(lines).alias("line")).select("mol_id", "b", F.regexp_extract("line", r"^\s*(\d+)", 1).cast("int").alias("atom_idx"), rows_of(numbers(F.col("line")), 3).alias("v"))
    each = atoms.select("mol_id", "b", "atom_idx", F.posexplode_outer("v").alias("k", "d")).where("k IS NOT NULL")  # an inner one computes v again, to filter
    return each.select("mol_id", ((F.col("b") - 1) * 3 + F.col("k") + 1).alias("mode_idx"), "atom_idx", *[F.get("d", F.lit(i)).alias(n) for i, n in enumerate("xyz")])


def _energies() -> list[Column]:
    text = F.col("text")
    scf = F.element_at(F.regexp_extract_all(text, F.lit(r"SCF Done:[^=]*=\s*([-+]?\d+\.\d+)"), F.lit(1)), -1)
    tail = F.element_at(F.split(text, r"occ\. eigenvalues --", -1), -1)
    occupied, virtual = numbers(F.element_at(F.split(tail, "\n", -1), 1)), numbers(block(tail, "virt. eigenvalues --", "\n", 1))
    gap = (F.element_at(virtual, 1) - F.element_at(occupied, -1)) * HARTREE_EV
    return [F.when(F.size(F.regexp_extract_all(text, F.lit(r"SCF Done:[^=]*=\s*([-+]?\d+\.\d+)"), F.lit(1))) > 0, scf.cast("double")).alias("scf_energy"), F.when((F.size(virtual) > 0) & (F.size(occupied) > 0) & F.contains(text, F.lit("occ. eigenvalues --")), gap).alias("homo_lumo_gap_ev")]


def log_energies(logs: DataFrame) -> DataFrame:
    """(mol_id, scf_energy in Hartree, homo_lumo_gap_ev): the last SCF energy; last occupied to first virtual eigenvalue after it."""
    return logs.select("mol_id", *_energies())


def log_bond_orders(logs: DataFrame) -> DataFrame:
    """(mol_id, a1, a2, bond_order) from the BD lines of an NBO summary; lone_pairs() has the LP lines."""
    rows = logs.select("mol_id", F.explode(F.regexp_extract_all(F.coalesce(block(F.col("text"), "NATURAL BOND ORBITALS", "RY*("), F.lit("")), F.lit(r"BD \(\s*\d+\)\s*[A-Z][a-z]?\s*\d+\s*-\s*[A-Z][a-z]?\s*\d+"), F.lit(0))).alias("line"))
    end = lambda n: F.regexp_extract("line", r"\)\s*[A-Z][a-z]?\s*(\d+)\s*-\s*[A-Z][a-z]?\s*(\d+)", n).cast("int")
    return rows.select("mol_id", F.least(end(1), end(2)).alias("a1"), F.greatest(end(1), end(2)).alias("a2")).groupBy("mol_id", "a1", "a2").agg(F.count("*").alias("bond_order"))


def log_bonds(logs: DataFrame) -> DataFrame:
    """(mol_id, a1, a2, length): the bonds R(i,j) that an optimisation lists, with their last value."""
    found = F.regexp_extract_all("text", F.lit(r"R\(\d+,\d+\)\s+[-+]?\d+\.\d+"), F.lit(0))
    rows = logs.select("mol_id", F.posexplode(found).alias("k", "r")).select("mol_id", "k", *[F.regexp_extract("r", r"R\((\d+),(\d+)\)", i).cast("int").alias(f"a{i}") for i in (1, 2)], F.regexp_extract("r", r"([-+]?\d+\.\d+)$", 1).cast("double").alias("length"))
    return rows.groupBy("mol_id", F.least("a1", "a2").alias("a1"), F.greatest("a1", "a2").alias("a2")).agg(F.max_by("length", "k").alias("length"))


def log_lone_pairs(logs: DataFrame) -> DataFrame:
    rows = logs.select("mol_id", F.explode(F.regexp_extract_all(F.coalesce(block(F.col("text"), "NATURAL BOND ORBITALS", "RY*("), F.lit("")), F.lit(r"LP \(\s*\d+\)\s*[A-Z][a-z]?\s*(\d+)"), F.lit(1))).alias("a"))
    return rows.groupBy("mol_id", F.col("a").cast("int").alias("atom_idx")).agg(F.count("*").alias("lone_pairs"))


def formal_charges(atoms: DataFrame, orders: DataFrame, pairs: DataFrame) -> DataFrame:
    """(mol_id, atom_idx, formal): valence electrons less two a lone pair and one a bond."""
    from gneiss.functions.elements import lookup

    ends = orders.select("mol_id", F.explode(F.array("a1", "a2")).alias("atom_idx"), "bond_order").groupBy("mol_id", "atom_idx").agg(F.sum("bond_order").alias("bonds"))
    both = atoms.join(ends, ["mol_id", "atom_idx"], "left").join(pairs, ["mol_id", "atom_idx"], "left")
    return both.select("mol_id", "atom_idx", (lookup(F.col("symbol"), "valence") - 2 * F.coalesce("lone_pairs", F.lit(0)) - F.coalesce("bonds", F.lit(0))).alias("formal"))


def summary(logs: DataFrame) -> DataFrame:
    """(mol_id, has_geometry, has_charges, has_modes, normal_end): what a log holds; files with gaps stay visible."""
    text = F.col("text")
    has = lambda s: F.contains(text, F.lit(s))
    return logs.select("mol_id", has("Standard orientation:").alias("has_geometry"), has("Summary of Natural Population Analysis").alias("has_charges"), has("Frequencies --").alias("has_modes"), has("Normal termination").alias("normal_end"))


WANTED = {"geometry": "Standard orientation:", "charges": "Summary of Natural Population Analysis", "hirshfeld": "Hirshfeld charges, spin densities", "dipole": "Dipole moment", "modes": "Frequencies --", "energy": "SCF Done:", "normal end": "Normal termination"}


def _errors(n_atoms: Column, n_charges: Column) -> Column:
    gaps = F.filter(F.array(*[F.when(~F.contains("text", F.lit(m)), F.lit(f"no {k}")) for k, m in WANTED.items()]), lambda x: x.isNotNull())
    odd = F.when((n_atoms > 0) & (n_charges > 0) & (n_atoms != n_charges), F.array(F.format_string("%d charges for %d atoms", n_charges, n_atoms))).otherwise(F.array().cast("array<string>"))
    return F.concat(gaps, odd).alias("errors")


def errors(logs: DataFrame) -> DataFrame:
    """(mol_id, errors array<string>): what each log lacks, block by block, and charges that aren't as many as its atoms."""
    counted = logs.select("mol_id", "text", F.size(_atom_lines()).alias("n_atoms"), F.size(_npa_charges()).alias("n_charges"))
    return counted.select("mol_id", _errors(F.col("n_atoms"), F.col("n_charges")))


def wide(logs: DataFrame) -> DataFrame:
    """A row for each atom with all that a log says of it and of its molecule: symbol, place, charges (nbo, hirshfeld, cm5), dipole,
    polarizability, energies, and the molecule's errors. A log without a geometry keeps one row, without an atom.

    All of it is made of one log in its own row: nothing is shuffled or joined, and no text is read twice."""
    whole = logs.select("mol_id", "text", _atom_lines().alias("lines"), _npa_charges().alias("npa"), _hirshfeld().alias("rows"), _dipole().alias("v"), *_polarizability(), *_energies())
    atom = lambda line, k: F.struct(_cells(line).alias("c"), F.get("npa", k).alias("nbo"), F.get("rows", k).alias("r"))
    dipole = [F.when(F.size("v") >= 4, F.get("v", F.lit(i))).alias(n) for i, n in enumerate(("dip_x", "dip_y", "dip_z", "total_dipole"))]
    own = whole.select("mol_id", F.transform("lines", atom).alias("atoms"), *dipole, "iso", "aniso", "scf_energy", "homo_lumo_gap_ev", _errors(F.size("lines"), F.size("npa")))
    each = own.select("*", F.posexplode_outer("atoms").alias("k", "a")).drop("atoms")
    charges = [F.col("a.nbo").alias("nbo_charge"), F.get("a.r", F.lit(0)).alias("hirshfeld_charge"), F.get("a.r", F.lit(5)).alias("cm5_charge")]
    return each.select("mol_id", (F.col("k") + 1).alias("atom_idx"), *_atom(F.col("a.c")), *charges, "dip_x", "dip_y", "dip_z", "total_dipole", "iso", "aniso", "scf_energy", "homo_lumo_gap_ev", "errors")


#: What write_logs() makes of a folder of logs.
LOG_TABLES = {"atoms": log_atoms, "npa_charges": log_npa_charges, "hirshfeld": log_hirshfeld, "dipole": log_dipole, "polarizability": log_polarizability, "modes": log_modes, "displacements": log_displacements, "energies": log_energies, "wide": wide}


def write_logs(spark: SparkSession, path: str, folder: str, suffix: str = ".log") -> DataFrame:
    """Reads a folder of logs, writes each table of LOG_TABLES as Parquet, and returns the report: (mol_id, errors), no file left out."""
    logs = read_files(spark, path, suffix)
    for name, table in LOG_TABLES.items():
        table(logs).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")
    return errors(logs)


# --- geometries, JSON, cubes ------------------------------------------------------------------------------------------


def xyz_atoms(files: DataFrame) -> DataFrame:
    """(mol_id, frame, energy, atom_idx, symbol, x, y, z) of XYZ texts with one or more frames; energy is the comment line if a number."""
    lines = F.split(F.rtrim(F.regexp_replace("text", "\r", "")), "\n", -1)
    n = F.trim(F.get(lines, F.lit(0))).try_cast("int")
    rows = files.select("mol_id", n.alias("n"), lines.alias("l")).where("n > 0").select("mol_id", "n", "l", F.posexplode("l").alias("at", "line"))
    rows = rows.select("mol_id", F.expr("at div (n + 2)").cast("int").alias("frame"), F.expr("at % (n + 2) - 1").cast("int").alias("atom_idx"), F.trim(F.get("l", F.expr("cast(at - at % (n + 2) + 1 as int)"))).try_cast("double").alias("energy"), F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ").alias("c"))
    return rows.where("atom_idx > 0 AND size(c) >= 4").select("mol_id", "frame", "energy", "atom_idx", F.get("c", F.lit(0)).alias("symbol"), *[F.get("c", F.lit(1 + i)).try_cast("double").alias(x) for i, x in enumerate("xyz")])


JSON_SCHEMA = (
    "molecule struct<atoms: array<struct<symbol: string, x: double, y: double, z: double>>>, properties struct<dipole: array<double>, polarizability: struct<iso: double, aniso: double>>, "
    "vibrations struct<modes: array<struct<frequency: double, ir: double, displacements: array<array<double>>>>>, charges struct<nbo: array<double>, hirshfeld: array<double>, cm5: array<double>>, "
    "energies struct<scf: double, total: double, electronic: double, homo_lumo_gap: double>"
)


def json_rows(files: DataFrame) -> DataFrame:
    """Structured JSON texts (mol_id, text) by JSON_SCHEMA; what isn't JSON gives nulls."""
    return files.select("mol_id", F.from_json("text", JSON_SCHEMA).alias("j")).select("mol_id", "j.*")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return json_rows(read_files(spark, path, ""))


def json_dipole(j: DataFrame) -> DataFrame:
    """(mol_id, dx, dy, dz, total); a total that isn't given is the norm."""
    d = [F.get("properties.dipole", F.lit(i)) for i in range(4)]
    return j.where("properties.dipole IS NOT NULL").select("mol_id", *[c.alias(n) for c, n in zip(d, ("dx", "dy", "dz"), strict=False)], F.coalesce(d[3], F.sqrt(d[0] ** 2 + d[1] ** 2 + d[2] ** 2)).alias("total"))


def json_polarizability(j: DataFrame) -> DataFrame:
    return j.where("properties.polarizability IS NOT NULL").select("mol_id", "properties.polarizability.iso", "properties.polarizability.aniso")


def json_displacements(j: DataFrame) -> DataFrame:
    """(mol_id, mode_idx, atom_idx, x, y, z)."""
    modes = j.select("mol_id", F.posexplode("vibrations.modes").alias("k", "m"))
    each = modes.select("mol_id", (F.col("k") + 1).alias("mode_idx"), F.posexplode("m.displacements").alias("a", "d"))
    return each.select("mol_id", "mode_idx", (F.col("a") + 1).alias("atom_idx"), *[F.get("d", F.lit(i)).alias(n) for i, n in enumerate("xyz")])


def json_atoms(j: DataFrame) -> DataFrame:
    return j.select("mol_id", F.posexplode("molecule.atoms").alias("k", "a")).select("mol_id", (F.col("k") + 1).alias("atom_idx"), "a.symbol", "a.x", "a.y", "a.z")


def json_charges(j: DataFrame) -> DataFrame:
    """(mol_id, atom_idx, charge_type, charge)."""
    kinds = F.map_from_arrays(F.array(F.lit("nbo"), F.lit("hirshfeld"), F.lit("cm5")), F.array("charges.nbo", "charges.hirshfeld", "charges.cm5"))
    return j.select("mol_id", F.explode(kinds).alias("charge_type", "v")).select("mol_id", "charge_type", F.posexplode("v").alias("k", "charge")).select("mol_id", (F.col("k") + 1).alias("atom_idx"), "charge_type", "charge")


def json_modes(j: DataFrame) -> DataFrame:
    return j.select("mol_id", F.posexplode("vibrations.modes").alias("k", "m")).select("mol_id", (F.col("k") + 1).alias("mode_idx"), "m.frequency", "m.ir")


def json_energy(j: DataFrame) -> DataFrame:
    """The SCF energy, else the total, else the electronic one, else the orbital gap."""
    return j.select("mol_id", F.coalesce("energies.scf", "energies.total", "energies.electronic", "energies.homo_lumo_gap").alias("energy"))


def cube_points(files: DataFrame, iso: float = 0.001, width: float = 1.1) -> DataFrame:
    """(mol_id, x, y, z, density) in Angstrom of the voxels with iso <= density <= width * iso."""
    t = F.split(F.trim(F.regexp_replace(F.regexp_replace("text", r"^[^\n]*\n[^\n]*\n", ""), r"\s+", " ")), " ")
    head = files.select("mol_id", t.alias("t")).withColumn("natoms", F.abs(F.get("t", F.lit(0)).cast("int")))
    number = lambda i: F.get("t", F.lit(i)).cast("double")
    for k, axis in enumerate("ijk"):
        head = head.withColumn(f"n{axis}", number(4 + 4 * k).cast("int"))
        for m, c in enumerate("xyz"):
            head = head.withColumn(f"s{axis}{c}", number(5 + 4 * k + m))
    for m, c in enumerate("xyz"):
        head = head.withColumn(f"o{c}", number(1 + m))
    data = head.withColumn("d", F.expr("slice(t, 17 + 5 * natoms, greatest(size(t), 1))")).drop("t")
    cells = data.select("*", F.posexplode("d").alias("at", "v")).drop("d").withColumn("density", F.col("v").cast("double")).where(F.col("density").between(iso, iso * width))
    cells = cells.withColumn("kk", F.expr("at % nk")).withColumn("jj", F.expr("(at div nk) % nj")).withColumn("ii", F.expr("at div (nk * nj)"))
    place = [((F.col(f"o{c}") + F.col("ii") * F.col(f"si{c}") + F.col("jj") * F.col(f"sj{c}") + F.col("kk") * F.col(f"sk{c}")) * BOHR).alias(c) for c in "xyz"]
    return cells.select("mol_id", *place, "density")


def cube_atoms(files: DataFrame) -> DataFrame:
    """(mol_id, atom_idx, symbol, x, y, z) in Angstrom of the atoms that a cube lists."""
    t = F.split(F.trim(F.regexp_replace(F.regexp_replace("text", r"^[^\n]*\n[^\n]*\n", ""), r"\s+", " ")), " ")
    head = files.select("mol_id", t.alias("t")).withColumn("n", F.abs(F.get("t", F.lit(0)).cast("int"))).where("n > 0")
    each = head.select("mol_id", "t", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("atom_idx"))
    cell = lambda k: F.get("t", (F.col("atom_idx") - 1) * 5 + 16 + k)
    return each.select("mol_id", "atom_idx", symbol_of(cell(0).cast("int")).alias("symbol"), *[(cell(2 + i).cast("double") * BOHR).alias(c) for i, c in enumerate("xyz")])


def feather_tables(rows: DataFrame) -> dict[str, DataFrame]:
    """The six tables of read_feather()'s rows by the names of a wide frame's columns: atoms, dipole, polarizability, info (modes), charges
    and displacements; cells that are null, as the padding of shorter columns is, give no rows."""
    f = lambda name: F.try_element_at("fields", F.lit(name))
    number = lambda name: f(name).try_cast("double")
    at = (F.col("row") + 1).alias("atom_idx")
    moved = rows.select("mol_id", at, F.explode("fields").alias("name", "v")).select("mol_id", "atom_idx", F.regexp_extract("name", r"^mode_(\d+)_([xyz])$", 1).try_cast("int").alias("mode_idx"), F.regexp_extract("name", r"_([xyz])$", 1).alias("axis"), F.col("v").try_cast("double").alias("v")).where("mode_idx IS NOT NULL AND v IS NOT NULL")
    kinds = F.array(*[F.struct(F.lit(k).alias("charge_type"), number(f"{k}_charge").alias("charge")) for k in ("nbo", "hirshfeld", "cm5")])
    return {
        "atoms": rows.select("mol_id", at, f("atom").alias("symbol"), *[number(c).alias(c) for c in "xyz"]).where("x IS NOT NULL"),
        "dipole": rows.select("mol_id", number("dip_x").alias("dx"), number("dip_y").alias("dy"), number("dip_z").alias("dz"), number("total_dipole").alias("total")).where("total IS NOT NULL"),
        "polarizability": rows.select("mol_id", number("iso").alias("iso"), number("aniso").alias("aniso")).where("iso IS NOT NULL"),
        "info": rows.select("mol_id", (F.col("row") + 1).alias("mode_idx"), number("Frequency").alias("frequency"), number("IR").alias("ir")).where("frequency IS NOT NULL"),
        "charges": rows.select("mol_id", at, F.inline(kinds)).where("charge IS NOT NULL"),
        "displacements": moved.groupBy("mol_id", "mode_idx", "atom_idx").agg(*[F.max(F.when(F.col("axis") == c, F.col("v"))).alias(c) for c in "xyz"]),
    }


def read_feather(spark: SparkSession, path: str) -> DataFrame:
    """Arrow IPC (feather) files of a folder as one DataFrame of their rows in JSON: (mol_id, row, fields map<string,string>)."""
    import io

    import pyarrow as pa
    import pyarrow.feather as feather

    def load(batches):
        for b in batches:
            ids, rows, fields = [], [], []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = feather.read_table(io.BytesIO(content))
                for i, r in enumerate(t.to_pylist()):
                    ids.append(path.rsplit("/", 1)[-1].rsplit(".", 1)[0])
                    rows.append(i)
                    fields.append([(str(k), None if v is None else str(v)) for k, v in r.items()])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(rows, pa.int32()), pa.array(fields, pa.map_(pa.string(), pa.string()))], ["mol_id", "row", "fields"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.feather").load(path).select("path", "content")
    return files.mapInArrow(load, "mol_id string, row int, fields map<string,string>")


def read_features(spark: SparkSession, path: str, name: str | None = None, target: str = "output", drop: tuple[str, ...] = (), keep_unlabelled: bool = False) -> DataFrame:
    """A feature CSV: the name column (the first, if not told) and the target are found whatever their case, SMILES-like and dropped
    columns go, the rest is cast to double. A column name that comes again gets #2, #3, ...; columns without any number go, and rows
    without a target, unless they are kept."""
    head = spark.read.option("header", False).csv(path).first()
    names, seen = [], {}
    for i, c in enumerate((c or "").strip() or f"column {i + 1}" for i, c in enumerate(head or ())):
        seen[c.lower()] = seen.get(c.lower(), 0) + 1
        names.append(c if seen[c.lower()] == 1 else f"{c}#{seen[c.lower()]}")
    raw = spark.read.option("header", True).option("enforceSchema", True).schema(", ".join(f"`c{i}` string" for i in range(len(names)))).csv(path)
    at = {c: f"c{i}" for i, c in enumerate(names)}
    first = next((c for c in names if name and c.lower() == name.lower()), names[0] if names else None)
    goal = next((c for c in names if c.lower() == target.lower()), None)
    if goal is None:
        raise ValueError(f"no column {target}; there are {', '.join(names)}")
    rest = [c for c in names if c not in (first, goal) and c not in drop and "smiles" not in c.lower()]
    out = raw.select(F.col(at[first]).alias("name"), *[F.col(at[c]).try_cast("double").alias(c) for c in rest], F.col(at[goal]).try_cast("double").alias("target"))
    filled = out.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(rest)]).first() if rest else ()
    out = out.drop(*[c for c, n in zip(rest, filled, strict=True) if not n])
    return out if keep_unlabelled else out.where("target IS NOT NULL")


def read_request(path: str) -> dict:
    """A request of features as JSON, prompt to answer, on the driver: answers are selectors as text, or numbers."""
    import json

    with open(path, encoding="utf-8") as f:
        request = json.load(f)
    if not isinstance(request, dict):
        raise ValueError("a request is a JSON object")
    return request
