"""Grammars of the checked languages and the error-correcting chart parser over them."""
