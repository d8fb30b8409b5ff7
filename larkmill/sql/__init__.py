"""The dialect: tokens, syntax trees and the parser."""

from larkmill.sql.parser import parse

__all__ = ["parse"]
