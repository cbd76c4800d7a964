"""Reading and writing tables, and the views built over them."""
