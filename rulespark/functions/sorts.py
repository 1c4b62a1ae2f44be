"""Sorts (types of values) and how Spark holds them."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Sorts that are always there, with their Spark types. BigInt is a decimal number, BigRat a reduced fraction "n/d".
BASE = {"Unit": "boolean", "String": "string", "bool": "boolean", "i64": "bigint", "f64": "double", "BigInt": "string", "BigRat": "string"}
#: Kinds of containers and how many sorts they take (UnstableFn: argument sorts, then the result's).
KINDS = {"Vec": 1, "Set": 1, "Map": 2, "MultiSet": 1, "Pair": 2, "UnstableFn": -1}


@dataclass(frozen=True)
class Sort:
    """kind: base, eq, or a container's kind; of: the sorts of a container's elements; takes: a function's arguments."""

    name: str
    kind: str
    of: tuple[Sort, ...] = ()
    unionable: bool = True
    takes: tuple[Sort, ...] = field(default=())

    @property
    def ddl(self) -> str:
        """Spark type. Containers are held by value: sets and maps sorted, multisets as sorted pairs of value and count."""
        match self.kind:
            case "base":
                return BASE[self.name]
            case "eq":
                return "bigint"
            case "Vec" | "Set":
                return f"array<{self.of[0].ddl}>"
            case "Map":
                return f"array<struct<k:{self.of[0].ddl},v:{self.of[1].ddl}>>"
            case "MultiSet":
                return f"array<struct<v:{self.of[0].ddl},n:bigint>>"
            case "Pair":
                return f"struct<first:{self.of[0].ddl},second:{self.of[1].ddl}>"
            case "UnstableFn":
                return "struct<name:string,args:string>"
        raise ValueError(self.kind)

    @property
    def has_ids(self) -> bool:
        """Whether values hold ids that a union can change."""
        return self.kind == "eq" or any(s.has_ids for s in self.of)

    def __str__(self) -> str:
        return self.name


UNIT, STRING, BOOL, I64, F64, BIGINT, BIGRAT = (Sort(n, "base") for n in ("Unit", "String", "bool", "i64", "f64", "BigInt", "BigRat"))
BASE_SORTS = {s.name: s for s in (UNIT, STRING, BOOL, I64, F64, BIGINT, BIGRAT)}
