"""Named queries with the SQL they are checked against; importing this package registers them all."""

from importlib import import_module

for _name in ("arrays", "images", "transforms", "tracing", "matching", "ordered", "frames", "streams"):
    import_module(f"gridloom.plans.{_name}")
