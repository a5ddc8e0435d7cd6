"""Operators: encoding, splitting, scaling, population algebra, fitness."""
