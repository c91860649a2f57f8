"""Spark jobs that make tabular and event data ready for analysis and machine learning."""

from plumbline.blueprints import BLUEPRINTS, Blueprint, get_blueprint, register_blueprint
from plumbline.session import build_session, scratch_path

__all__ = ["BLUEPRINTS", "Blueprint", "get_blueprint", "register_blueprint", "build_session", "scratch_path"]
