"""Reading collections and exports, writing results."""
