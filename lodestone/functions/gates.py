"""Gate vocabularies: keyword tables that are data, not code paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The chunk gates with their keywords, in order of precedence.
CHUNK_GATES = {
    "MATH-CTRL": ["calculus", "algebra", "theorem", "proof", "matrix", "differential", "integral"],
    "PHYS-QUANT": ["physics", "quantum", "momentum", "force", "velocity", "energy", "particle"],
    "CHEM-BIO": ["chemistry", "biology", "molecule", "protein", "reaction", "cell", "enzyme"],
    "CODE-GEN": ["algorithm", "function", "class", "array", "loop", "recursion", "programming"],
    "AV-NAV": ["robot", "slam", "navigation", "autonomous", "lidar", "path planning", "localization"],
    "SPACE-AERO": ["rocket", "satellite", "aerospace", "orbital", "trajectory", "spacecraft"],
    "TELEM-LOG": ["telemetry", "logging", "monitoring", "diagnostics", "sensor data"],
    "HARD-SPEC": ["hardware", "specification", "circuit", "processor", "memory", "architecture"],
    "SYS-OPS": ["kernel", "driver", "embedded", "rtos", "firmware", "operating system"],
    "OLYMPIAD": ["competition", "problem solving", "olympiad", "challenge", "mathematics"],
    "ROS2-ROBOT": ["ros", "ros2", "node", "topic", "service", "gazebo", "robot operating"],
    "PERSONALITY": ["polite", "helpful", "empathetic", "professional", "conversation"],
}
#: The query router's gates, in order of their class ids.
ROUTER_GATES = ["ROBO-CORE", "PHYS-DYN", "MATH-PROVE", "CODE-GEN", "DATA-TLM", "ACAD-MOTIV", "ELC-HW", "SPACE-AERO", "SEA-SUB", "BIO-MECH", "SFT-SEC"]
DEFAULT_CHUNK_GATE, DEFAULT_QUERY_GATE = "MATH-CTRL", "ACAD-MOTIV"

#: A table for the synthetic texts: strings that 5 to 60 % of them contain.
SYNTHETIC_GATES = {
    "EN-ALPHA": ["the", "tion", "ing"],
    "EN-BETA": ["whea", "onsh", "erst"],
    "DE-ALPHA": ["und", "keit", "pf"],
    "DE-BETA": ["schaft", "lich", "ver"],
    "FR-ALPHA": ["eaux", "tion", "aient"],
    "FR-BETA": ["ê", "ouq", "leur"],
    "ES-ALPHA": ["ción", "ado", "mente"],
    "ES-BETA": ["ía", "que", "ando"],
    "MARKS": ["###", "!!", "|"],
    "RARE": ["ros", "zz", "qq"],
}


def gate_table(spark: SparkSession, gates: dict[str, list[str]]) -> DataFrame:
    """(ordinal, gate, keywords): a fixed table of a dozen rows or so."""
    return spark.createDataFrame([(i, g, k) for i, (g, k) in enumerate(gates.items())], "ordinal int, gate string, keywords array<string>")


def load_gates(spark: SparkSession, path: str) -> DataFrame:
    """Gate configuration from YAML: ``gates`` with id, name, keywords, model, provider and so on."""
    import yaml

    with open(path) as f:
        rows = yaml.safe_load(f)["gates"]
    fields = ["id", "name", "display_name", "description", "specialist_model", "provider", "context_window", "reasoning", "keywords", "verifier", "verification_strict"]
    return spark.createDataFrame(
        [tuple(r.get(f) for f in fields) for r in rows],
        "id int, name string, display_name string, description string, specialist_model string, provider string, context_window int, reasoning string, keywords array<string>, verifier string, verification_strict boolean",
    )
