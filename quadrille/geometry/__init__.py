"""Geometry support: native expressions over coordinates (``native``) and JTS operations over WKB (``jts``)."""
